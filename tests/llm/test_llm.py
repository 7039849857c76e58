"""The training-data operators on small inputs: brute force, round trips, empty and odd rows."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from dossier.llm import decontaminate, langid, lattice, licenses, ngram_join, packing, pii, warc
from dossier.llm.base import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, h int"
LONG = "lorem ipsum dolor sit amet " * 3000


def docs_of(spark, texts):
    rows = [(i, t, "en", None, None if t is None else len(t), "clash", i) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same words here"), (5, "same words here"), (None, "same words here"), (6, "é" * 300)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in rows}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            least[hi] = lo
    return {i: root(i) for i, _ in rows}


def near_copies():
    rng, rows = np.random.default_rng(3), []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(12):
            words = list(base)
            for at in rng.integers(0, 120, k // 3):
                words[at] = f"x{g}{k}"
            rows.append((g * 100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows", [near_copies(), [r for r in ODD if r[0] != 5] + [(5, "same words here"), (7, "Same  words here")]])
def test_components_equal_brute_force(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs_of(spark, rows)).collect() if r["doc_id"] is not None}
    wanted = brute_components(rows)
    assert got == {i: (len(shingles(t)), wanted[i]) for i, t in rows if i is not None}


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/ü", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big)]
    folder = shared_folder(spark, "warc-test")
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder)
    listed = spark.createDataFrame(archives.collect(), archives.schema)
    got = {r["page_id"]: r for r in warc.read_archives(listed, folder).collect()}
    assert bytes(got[1]["payload"]).decode() == big and got[2]["refers_to"] == 1 and got[None]["refers_to"] == 1
    assert all(got[i]["record_type"] == "response" for i in (1, 3, 4, 5, 6)) and all(r["digest_ok"] for r in got.values())
    assert {r["page_id"]: r["payload_bytes"] for r in warc.resolved(warc.read_archives(listed, folder)).collect()}[2] == len(big)


def test_damaged_archive_raises():
    import io

    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = member.compress(warc.record(1, "u", b"abc", warc.digest(b"abc"), None)) + member.flush()
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(data * 2), 7)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))


@pytest.mark.parametrize("text, names, unmatched", [
    ("Intro line\nReleased under the MIT License.\nMore text", ["MIT"], []),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in\n"
     "# compliance with the License.\n", ["Apache-2.0"], []),
    ("We are not licensed under the MIT License at all.", [], []),
    ("All rights reserved.\nLicensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"], ["all-rights"]),
    ("// SPDX-License-Identifier: MIT\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only", "MIT"], []),
    (None, [], []), ("", [], []),
])
def test_licences(spark, text, names, unmatched):
    row = licenses.licences(docs_of(spark, [(1, text)])).head()
    assert row["licenses"] == names and row["unmatched"] == unmatched


def test_rules_name_known_sentences():
    assert {i for _, rule in licenses.RULES for i in rule.split()} <= set(licenses.SENTENCES)
    assert len(licenses.IDENTIFIERS) == sum(map(len, licenses.SENTENCES.values()))


def test_pieces_are_whole_and_sequences_gapless(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = ODD + [(100 + i, "some words " * (37 * i % 900)) for i in range(40)]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs_of(spark, rows)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in rows:
        if i == 5:
            continue
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in by_doc[5]) == 2 * by_doc[5][0]["doc_tokens"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_items_in_documents(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = ODD + [(10, LONG + item.upper() + " " + LONG), (11, item[:60]), (12, " ".join(item.split()[:28]) + " x y")]
    items = spark.createDataFrame([(1, item), (2, None), (3, "same words here"), (4, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs_of(spark, rows), items).collect()}
    wanted = {(d, i) for d, t in rows for i, x in ((1, item), (3, "same words here")) if d is not None
              and 100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(x))}
    assert got == wanted
    left = decontaminate.decontaminated(docs_of(spark, rows), items)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in wanted}


@pytest.mark.parametrize("text, kind, span", [
    ("write to jo.do@mail.example.org now", "email", "jo.do@mail.example.org"),
    ("write to jo [at] mail [dot] org now", "email", "jo [at] mail [dot] org"),
    ("host 10.0.0.255 up", "ip", "10.0.0.255"),
    ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111"),
    ("call +49 (30) 1234567 now", "phone", "+49 (30) 1234567"),
    ("mail jо@mail.com", "email", "jо@mail.com"),
])
def test_spans_are_source_offsets(text, kind, span):
    plain, added = pii.find_spans(text)
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in plain + added]
    assert (kind, span) in found and span not in pii.masked(text)


@pytest.mark.parametrize("text, kind, span, read", [
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs", None),
    ("llama más tres cuatro nueve uno dos tres cuatro cinco seis siete hoy", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete", None),
    ("le plus trois trois un deux zéro quatre cinq six sept huit ici", "phone", "plus trois trois un deux zéro quatre cinq six sept huit", None),
    ("call + four four double five one two triple three nine now", "phone", "+ four four double five one two triple three nine", None),
    ("jo arroba mail punto com", "email", "jo arroba mail punto com", None), ("jo arroba mail.com.", "email", "jo arroba mail.com", None),
    ("jo at mail dot xyz", "email", "jo at mail dot xyz", None), ("jo@mail dot com", "email", "jo@mail dot com", None),
    ("jo@mail punkt de", "email", "jo@mail punkt de", None), ("jo arobase mail point fr", "email", "jo arobase mail point fr", None),
    ("jo [arroba] mail [punto] es", "email", "jo [arroba] mail [punto] es", None), ("jo at a.b dot c.d dot e dot museum", "email", "jo at a.b dot c.d dot e dot museum", None),
    ("x" * 300 + " at " + "y" * 200 + " dot org", "email", "x" * 300 + " at " + "y" * 200 + " dot org", None),
    ("Jo Ät Mail Punkt De", "email", "Jo Ät Mail Punkt De", None),
])
def test_disguises_of_four_languages(monkeypatch, text, kind, span, read):
    got = pii.find_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in got[1]] == [(kind, span)] and span not in pii.masked(text)
    monkeypatch.setattr(pii, "says_something", lambda text: True)
    assert got == pii.find_spans(text)


@pytest.mark.parametrize("text", [
    "look at this point we agree", "look at example.com now", "mas un dos", "at noon. Point taken", "a point de vue at home", "jo at mail dot 5",
    "un deux trois", "@ point", "jo arroba mail", "double five", "plus one more", "jo@mail point"])
def test_plain_words_are_no_disguise(text):
    assert pii.find_spans(text)[1] == []


NUMBER = "one five five five one two three four five six".split()


@pytest.mark.parametrize("run", [
    "plus,four," + ",".join(NUMBER), "plus.four." + ".".join(NUMBER), "Plus-Four-" + "-".join(NUMBER), "plus\tfour\n" + "\n".join(NUMBER),
    "plus four, " + ", ".join(NUMBER), "plus,fıve," + ",".join(NUMBER), "plus,four,\u2028" + ",".join(NUMBER)])
@pytest.mark.parametrize("around", ["{}", "({})", "[{}]", "call:{};now", "<b>{}</b>", "\"{}\""])
def test_spelled_runs_are_found_with_and_without_the_quick_test(monkeypatch, run, around):
    text = around.format(run)
    got = pii.find_spans(text)
    monkeypatch.setattr(pii, "says_something", lambda text: True)
    assert got == pii.find_spans(text)
    if "ı" not in run:
        assert [(k, text[s:e]) for s, k, e in got[1]] == [(3, run)]


@pytest.mark.parametrize("text", ["jo[dot]do [AT] mail {poınt} org", "jo at mail dot org", "ann at MAIL DOT ORG", "jo(at)mail<.>org", "four,one", "someone,4 1 2 3", ""])
def test_quick_test_changes_nothing(monkeypatch, text):
    got = pii.find_spans(text)
    monkeypatch.setattr(pii, "says_something", lambda text: True)
    assert got == pii.find_spans(text)


def test_clean_text_stays(spark):
    assert pii.find_spans("Version 1.2.3 of two or three things, at noon.") == ([], [])
    assert [r["text"] for r in pii.redact(docs_of(spark, ODD)).collect()] == [t for _, t in ODD]


def brute_scores(rows):
    train, ends = Counter(), 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update((t or "").encode().lower().split())
            ends += 1
    total = sum(train.values()) + ends
    prior = lattice.vocabulary()
    arcs, expected = lattice.arcs_of(prior), Counter()
    for w in train:
        lattice.expect(w, arcs, expected)
    mass = sum(expected.values()) + lattice.PRIOR
    arcs = lattice.arcs_of({p: (expected[p] + lattice.PRIOR * q) / mass for p, q in prior.items()})
    kinds, out = len(train), {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        below = total + 0.1 * (kinds + (ends > 0) + 1)
        base = sum(math.log10((train[w] + 0.1) / below) for w in words) + math.log10((ends + 0.1) / below)
        model = math.log10((ends + 1) / (total + 2)) + sum(math.log10(
            (max(train[w] - lattice.DISCOUNT, 0) + (lattice.DISCOUNT * kinds + 1) * math.exp(lattice.spelling(w, arcs))) / (total + 2)) for w in words)
        out[i] = (len(words) + 1, sum(train[w] > 0 for w in words) + (ends > 0), total, base, model)
    return out


@pytest.mark.parametrize("rows", [[r for r in ODD if r[0] != 6] + [(20 + i, f"alpha beta w{i} gamma " * i) for i in range(30)], [(None, "a b"), (3, None)], []])
def test_scores_equal_brute_force(spark, rows):
    got = lattice.score(docs_of(spark, rows)).collect()
    wanted = brute_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == pytest.approx(wanted[r["doc_id"]], rel=1e-9)


def test_forward_sums_all_segmentations():
    weights = {b" ": 0.1, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b" a": 0.2, lattice.STOP: 0.2}
    arcs = lattice.arcs_of(weights)

    def every(s):
        return 1.0 if not s else sum(weights[s[:n]] * every(s[n:]) for n in range(1, len(s) + 1) if s[:n] in weights)

    assert math.exp(lattice.spelling(b"abab", arcs)) == pytest.approx(every(b" abab") * 0.2)


def test_vocabulary_is_a_distribution():
    assert sum(lattice.vocabulary().values()) == pytest.approx(1.0)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.trained_on(docs)).withColumnRenamed("doc_id", "d")
    rows = docs.join(out, docs["doc_id"] == out["d"]).where("lang is not null and lang_pred <> 'und'").where(langid.held_out(docs["doc_id"])).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.trained_on(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    empty = docs.where("false")
    assert langid.predict(docs, langid.trained_on(empty)).where("lang_pred <> 'und'").count() == 0


def test_sample_keeps_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_SAMPLE", 200)
    rows = [(100 * k + i, f"text {i} of {k}", f"l{k:02}") for k in range(25) for i in range(100)] + [(9000, "alone", "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").orderBy("lang")
    first, again = (langid._sample(d, 100).collect() for d in (docs, docs.orderBy("doc_id").repartition(7)))
    counts = Counter(r["lang"] for r in first)
    assert set(counts) == {r[2] for r in rows} and sum(counts.values()) <= 200 and counts["rare"] == 1
    assert set(counts[f"l{k:02}"] for k in range(25)) == {200 // 26} and sorted(first) == sorted(again)
    copies = spark.createDataFrame([(1, "same", "en")] * 300, "doc_id bigint, text string, lang string")
    assert langid._sample(copies, 100).count() == 100


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    now = stages["language"](spark, docs, SF)
    assert now.columns == docs.columns and now.count() >= 0.95 * docs.where("text is not null").count() - 5
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    kept = stages["near_copies"](spark, now, SF)
    least = brute_components(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in least.items() if i == c)
    wanted = {i: shingles(t) for i, t in rows if least[i] == i}
    sets = [shingles(r["text"]) for r in items]
    clean = {i for i, s in wanted.items() if not any(x and 100 * len(x & s) >= 75 * len(x) for x in sets)}
    left = stages["decontamination"](spark, kept, SF)
    assert {r["doc_id"] for r in left.collect()} == clean
    masked = stages["personal_data"](spark, left, SF)
    texts = dict(rows)
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {i: pii.masked(texts[i]) for i in clean}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == clean


def test_pipeline_on_repeated_and_odd_rows(spark):
    rows = corpus_pipeline.one_of_near_copies(spark, docs_of(spark, ODD), SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 2, 3, 4, 5, None, 6]) and len(rows[0]) == 7
    assert corpus_pipeline.one_of_near_copies(spark, docs_of(spark, []), SF).count() == 0
