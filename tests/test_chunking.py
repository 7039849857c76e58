"""Chunks: the rules, and properties over random texts."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.functions.vectors import hash_embed, l2_normalise, vectors_from_payload
from dossier.operators import chunking, embedding


def greedy(text, size, overlap):
    """The packing rule word by word, as an independent check."""
    words, start, out = text.split(), 0, []
    while start < len(words):
        end, used = start, -1
        while end < len(words) and used + 1 + len(words[end]) <= size:
            used += 1 + len(words[end])
            end += 1
        end = max(end, start + 1)
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        back, room = end, overlap
        while back - 1 > start and len(words[back - 1]) + 1 <= room:
            room -= len(words[back - 1]) + 1
            back -= 1
        start = back
    return out


def test_packing_equals_the_word_by_word_rule():
    rng = random.Random(7)
    for _ in range(3000):
        text = " ".join("x" * rng.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randrange(0, 30)))
        size = rng.randrange(1, 40)
        overlap = rng.randrange(0, size)
        pieces = chunking.pack_words(text, size, overlap)
        assert pieces == greedy(text, size, overlap)
        assert all(len(p) <= size or " " not in p for p in pieces)
        assert set(" ".join(pieces).split()) == set(text.split())


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, 10), (10, -1), (5, 9)])
def test_bad_parameters(size, overlap):
    with pytest.raises(ValueError):
        chunking.packed_pieces(None, size, overlap)
    with pytest.raises(ValueError):
        chunking.windows(None, size, overlap)


def test_sequence_runs_over_pages_and_pages_do_not_mix(frame):
    pages = frame([(1, 2, "d e"), (1, 1, "a b c"), (1, 3, "  "), (2, 1, "z"), (1, 4, "f")],
                  "document_id bigint, page_number int, text string")
    got = chunking.chunk_fixed(pages, 3, 0).orderBy("document_id", "sequence").collect()
    assert [(r["document_id"], r["page_number"], r["sequence"], r["text"]) for r in got] == [
        (1, 1, 0, "a b"), (1, 1, 1, "c"), (1, 2, 2, "d e"), (1, 4, 3, "f"), (2, 1, 0, "z")]


def test_nested_and_row_chunking_agree(spark, frame):
    rng = random.Random(3)
    rows = [(d, p, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))))
            for d in range(6) for p in range(1, 8)]
    # One document has most of the pages.
    rows += [(0, p, f"page {p} " + "long words here " * 5) for p in range(8, 200)]
    pages = frame(rows, "document_id bigint, page_number int, text string")
    flat = chunking.chunk_fixed(pages, 30, 10).select("document_id", "page_number", "sequence", "text")
    nested = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    other = nested.select("document_id", F.inline(chunking.chunk_document(F.col("pages"), 30, 10))).select(
        "document_id", "page_number", "sequence", "text")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, other.collect()))


def case(sections, court="C", city=None, date=""):
    return [("7", court, city, date, sections)]


CASE_SCHEMA = "case_id string, court string, city string, date string, sections array<struct<name:string,text:string>>"


def test_windows_of_a_case(frame):
    rows = frame(case([("facts", "1 2 3 4 5 6 7 8"), ("empty", "  "), ("verdict", "x y")]), CASE_SCHEMA)
    got = chunking.chunk_windows(rows, 5, 2).orderBy("chunk_index").collect()
    assert [(r["section"], r["chunk_index"], r["total_in_case"], r["body"]) for r in got] == [
        ("facts", 0, 3, "1 2 3 4 5"), ("facts", 1, 3, "4 5 6 7 8"), ("verdict", 2, 3, "x y")]
    assert got[0]["header"] == "[القضية 7 | C | القسم: facts]"
    assert got[0]["text"] == got[0]["header"] + "\n" + got[0]["body"]


def test_window_counts(frame):
    for n in range(0, 40):
        text = " ".join(str(i) for i in range(n))
        pieces = frame([(text,)], "t string").select(chunking.windows(F.col("t"), 7, 3)).head()[0] if n in (
            0, 1, 7, 8, 11, 12, 39) else None
        if pieces is not None:
            want, start, words = [], 0, text.split()
            while start < len(words):
                want.append(" ".join(words[start:start + 7]))
                if start + 7 >= len(words):
                    break
                start += 4
            assert pieces == want


@pytest.mark.parametrize("court, city, date, header", [
    (None, None, None, "[القضية 7 | القسم: s]"), ("", "R", "", "[القضية 7 | R | القسم: s]"),
    ("C", "R", "D", "[القضية 7 | C | R | D | القسم: s]"),
])
def test_header(frame, court, city, date, header):
    rows = frame(case([("s", "x")], court, city, date), CASE_SCHEMA)
    assert chunking.chunk_windows(rows).head()["header"] == header


def test_empty_case_has_no_rows(frame):
    assert chunking.chunk_windows(frame(case([]), CASE_SCHEMA)).count() == 0


def test_preview(frame):
    rows = frame([(1, "a b c"), (2, "abcdefgh ij"), (3, "x")], "page_number int, text string")
    got = chunking.preview_chunks(rows, 1, 2, 5).orderBy("page_number").collect()
    assert [(r["text"], r["n_words"]) for r in got] == [("a b c", 3), ("abcde…", 2)]


# --- vectors ------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [1, 16, 33, 100])
def test_hash_embed_equals_the_provider(value, dims):
    own = value(hash_embed(F.lit("نص and text"), dims))
    other = embedding.HashProvider(dims).embed(["نص and text"])[0]
    assert own == pytest.approx(other, abs=1e-12) and len(own) == dims
    assert sum(x * x for x in own) == pytest.approx(1)


def test_normalise(value):
    assert value(l2_normalise(F.array(F.lit(3.0), F.lit(4.0)), 2)) == pytest.approx([0.6, 0.8])
    assert value(l2_normalise(F.array(F.lit(0.0), F.lit(0.0)), 2)) == [1.0, 0.0]
    with pytest.raises(Exception, match="vector width is 2, expected 3"):
        value(l2_normalise(F.array(F.lit(3.0), F.lit(4.0)), 3))


def test_embed_checks_the_width(frame):
    rows = frame([("a",), ("b",)], "text string")
    assert [len(r["embedding"]) for r in embedding.embed(rows, lambda: embedding.HashProvider(8), 8).collect()] == [8, 8]
    with pytest.raises(Exception, match="8-wide"):
        embedding.embed(rows, lambda: embedding.HashProvider(8), 9).collect()


def test_embed_of_nothing_makes_no_call(frame):
    def never():
        raise AssertionError("built without rows")

    assert embedding.embed(frame([], "text string"), never, 4).count() == 0


@pytest.mark.parametrize("payload, vectors, error", [
    ('{"data":[{"index":1,"embedding":[3,4]},{"index":0,"embedding":[1,2]}]}', [[1.0, 2.0], [3.0, 4.0]], None),
    ('{"data":[{"index":0,"embedding":[1,2]}]}', None, "Expected 2 vectors, got 1"),
    ('{"data":[{"index":0,"embedding":[1]},{"index":1,"embedding":[1,2]}]}', None,
     "Model produced a 1-wide vector, expected 2"),
    ('{"oops": 1}', None, "Unexpected response shape"), ("nonsense", None, "Unexpected response shape"),
    ('{"data":[{"embedding":[1,2]},{"index":1,"embedding":[1,2]}]}', None, "Unexpected response shape"),
])
def test_vectors_from_payload(frame, payload, vectors, error):
    got = frame([(payload,)], "p string").select(vectors_from_payload(F.col("p"), F.lit(2), 2).alias("v")).head()["v"]
    assert (got["vectors"], got["error"]) == (vectors, error)


def test_numbers_by_prefix_sums_and_by_placing_are_the_same(frame):
    """Pages of any number of pieces, blank ones, and two rows with one page number; the text itself is not shuffled."""
    rows = [(d, p, " ".join(f"w{d}{p}{i}" for i in range((d * 7 + p * 3) % 11))) for d in range(6) for p in (3, 1, 2, 9)] + [(2, 2, "again here"), (None, 1, "no document")]
    pages = frame(rows, "document_id bigint, page_number int, text string")
    few, many = chunking.chunk_fixed(pages, 12, 4), chunking.chunk_fixed(pages, 12, 4, most=1)
    assert set(few.columns) == set(many.columns)
    key = lambda r: (str(r["document_id"]), r["sequence"], r["page_number"])
    take = lambda df: sorted((key(r), r["text"]) for r in df.where("document_id <> 2").collect())
    assert take(few) == take(many)
    assert sorted(r["sequence"] for r in few.where("document_id = 2").collect()) == list(range(few.where("document_id = 2").count()))


def test_batches_are_python_objects_in_parts_only():
    import pyarrow as pa

    from dossier.functions.rows import parts_of, row_by_row

    column = pa.array([None, "", *["x" * 1000] * 500, "y" * 60_000, *["z"] * 300]).slice(1)
    parts = list(parts_of(column, 10_000))
    assert [at for at, _ in parts] == [0, *[at + n for at, n in parts][:-1]] and sum(n for _, n in parts) == len(column)
    assert all(n == 1 or column.slice(at, n).nbytes <= 20_000 for at, n in parts)
    assert row_by_row(column, len, pa.int64()).to_pylist() == [len(v) for v in column.to_pylist()]
    assert len(row_by_row(column.slice(0, 0), len, pa.int64())) == 0


def test_memory_of_a_batch_is_handed_back(monkeypatch):
    import pyarrow as pa

    from dossier.functions import rows

    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(rows.pa, "default_memory_pool", Pool)
    got = rows.row_by_row(pa.array(["a", None, "bc"]), lambda t: t and t * 2, pa.string())
    assert got.to_pylist() == ["aa", None, "bcbc"] and released == [True]
