"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing columns, and no rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quadra.llm import decontaminate, hmm, line_dedup, media_tiff, minhash, mixing, packing, pii, quality, warc

LONG = ("word " * 30 + "é😀 +1 (974) 555-3436 a@b.cc 1.2.3.4 4111 1111 1111 1111\n") * 600
TEXTS = [None, "", " \n\t ", "one", "one two", "Same text here again and again for everyone to read twice\n" * 3, LONG, "x" * 100_000, "\n" * 50, "\0\x01 odd \x7f bytes"]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size long, id string, n_lines long, _id long, contaminated string, _kept_id long, _d long, _text string, row int, rid int"


def docs(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = []
    if not empty:
        for i, t in enumerate(TEXTS):
            rows.append((i, t, None if i % 2 else "en", None if i == 3 else f"s{i % 3}", None, 1.0, None, 7, "i", 1, 5, "c", 1, 2, "t", 3, 4))
        rows += [rows[5], rows[5], rows[0], (None, "a text without id", *[None] * 15), tuple([None] * 17)]
    return spark.createDataFrame(rows, CLASH)


def labels(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = [] if empty else [(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, None), (5, 0, 0), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = [] if empty else [(1, "Same text here again and again for everyone to read twice"), (1, "one two"), (None, "odd"), (3, None), (4, ""), (4, "!!")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d, e: quality.score(d, labels(s, e)),
    "decontaminate": lambda s, d, e: decontaminate.contamination(d.drop("contaminated"), benchmark(s, e)),
    "matches": lambda s, d, e: decontaminate.matches(d, benchmark(s, e)),
    "media": lambda s, d, e: media_tiff.text_media(d),
    "pii": lambda s, d, e: pii.personal_data(d),
    "hmm": lambda s, d, e: hmm.score(d, states=2, rounds=1),
    "minhash": lambda s, d, e: minhash.groups(d),
    "packing": lambda s, d, e: packing.packed_rows(d, row_len=128),
    "mixing": lambda s, d, e: mixing.mix_plan(d),
    "lines": lambda s, d, e: line_dedup.drop_repeated(d, min_docs=2, batches=2),
}
#: Operators with a row per input row.
SAME = {"quality", "decontaminate", "media", "pii", "hmm", "minhash", "mixing", "lines"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark: SparkSession, name: str) -> None:
    d = docs(spark)
    got = OPERATORS[name](spark, d, False).collect()
    if name in SAME:
        assert len(got) == d.count()


def _told(rows: list, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def test_defined_results(spark: SparkSession) -> None:
    """What the docstrings define for null, empty, wordless and short texts, repeated rows, and null ids."""
    d = docs(spark)
    text = [(r["doc_id"], r["text"]) for r in d.collect()]
    run = lambda name: OPERATORS[name](spark, d, False).collect()
    # 0 null (twice), 1 empty, 2 blanks, 3 "one", 4 "one two", 5 three times, None: a text and a null
    scores = defaultdict(set)
    for r in quality.score(d, labels(spark).where("doc_id > 1")).collect():  # a taught document leaves itself out
        scores[r["doc_id"]].add(r["score"])
    assert scores[0] == scores[1] and len(scores[5]) == 1 and all(0 <= x <= 1 for v in scores.values() for x in v)

    none = hashlib.sha256(b"").hexdigest()
    sha = lambda *items: hashlib.sha256(",".join(items).encode()).hexdigest()
    got = _told([r for r in run("decontaminate") if r["doc_id"] in (0, 1, 2, 3, 4, 8, 9)], "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "longest", "longest_item", "longest_at")
    assert got == [(0, 0, 0, 0, none, 0, None, None), (0, 0, 0, 0, none, 0, None, None), (1, 0, 0, 0, none, 0, None, None), (2, 0, 0, 0, none, 0, None, None), (3, 1, 0, 0, none, 0, None, None),
                   (4, 2, 2, 1, sha("1"), 2, "1", 0), (8, 0, 0, 0, none, 0, None, None), (9, 2, 1, 1, sha("null"), 1, "null", 0)]

    media = defaultdict(set)
    for r in run("media"):
        media[r["doc_id"]].add(tuple(r)[1:])
    assert media[0] == media[1] and len(media[5]) == 1
    assert next(iter(media[0]))[:3] == (0, 64, hashlib.sha256(bytes(64)).hexdigest())

    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in run("pii") if r["doc_id"] in (0, 1, 2, 7)}
    assert set(map(tuple, spans.values())) == {()}

    models = [r for r in run("hmm")]
    assert _told([r for r in models if r["doc_id"] in (0, 1, 2, 3)], "doc_id", "n_tokens") == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 2)]
    assert len({r["score"] for r in models if r["doc_id"] in (0, 1, 2)}) == 1 and not any(r["held_out"] for r in models if r["doc_id"] is None)

    near = _told([r for r in run("minhash") if r["doc_id"] in (0, 1, 3, 4, 5, None)], "doc_id", "n_shingles", "component_id", "kept")
    assert near == [(0, 0, 0, True), (0, 0, 0, True), (1, 0, 1, True), (3, 1, 3, True), (4, 1, 4, True), (5, 11, 5, True), (5, 11, 5, True), (5, 11, 5, True), (None, 0, None, True), (None, 1, None, True)]

    rows = run("packing")
    assert sorted((x for r in rows for x in r["empty_ids"]), key=str) == sorted([0, 0, 1, None], key=str)
    assert Counter(x for r in rows for x, s in zip(r["doc_ids"], r["starts"], strict=True) if s == 0) == Counter(i for i, t in text if t)

    sizes = {r["doc_id"]: r["size"] for r in run("mixing") if r["doc_id"] is not None}
    assert sizes == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in text if i is not None}

    lines = _told([r for r in run("lines") if r["doc_id"] in (0, 1, 2, 5, 8)], "doc_id", "n_lines", "n_dropped", "text")
    same = TEXTS[5]
    assert lines == [(0, 1, 0, ""), (0, 1, 0, ""), (1, 1, 0, ""), (2, 2, 0, TEXTS[2]), (5, 4, 0, same), (5, 4, 0, same), (5, 4, 0, same), (8, 51, 0, TEXTS[8])]


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_without_rows(spark: SparkSession, name: str) -> None:
    assert OPERATORS[name](spark, docs(spark, True), False).count() == 0


@pytest.mark.parametrize("name", ["quality", "decontaminate", "matches"])
def test_operator_without_reference(spark: SparkSession, name: str) -> None:
    d = docs(spark)
    got = OPERATORS[name](spark, d, True).collect()
    assert len(got) == (0 if name == "matches" else d.count())
    if name == "quality":
        assert {r["score"] for r in got} == {0.5}


def _folder(spark: SparkSession, tmp_path, empty: bool) -> str:
    labels(spark, empty).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark, empty).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, empty).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark: SparkSession, tmp_path, empty: bool) -> None:
    folder = _folder(spark, tmp_path, empty)
    d = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, folder)
        if i < 4:
            assert out.columns == d.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
    assert d.columns[0] == "row_id"
    if empty:
        assert d.count() == 0


def test_warc(spark: SparkSession, tmp_path) -> None:
    rows = [(1, "http://a.com/x", "same"), (2, None, "same"), (None, "http://b.com", "same"), (3, "no url\n at all", None), (4, "", ""), (4, "", ""), (5, "http://[bad", LONG)]
    pages = spark.createDataFrame([(*r, 1, "f", 2, "k", b"p") for r in rows], "page_id long, url string, html string, offset long, file string, length long, key string, payload binary")
    places = warc.write_archives(pages, f"file://{tmp_path}/a").persist()
    assert places.count() == len(rows)
    root = warc.build_index(places, f"file://{tmp_path}/i").persist()
    want = Counter([(1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (3, "revisit", 4), (4, "response", None), (4, "response", None), (5, "response", None)])
    for back in (warc.read_archives(spark, f"file://{tmp_path}/a", places), warc.fetch(warc.resolve(warc.capture_keys(pages), root, f"file://{tmp_path}/i"), f"file://{tmp_path}/a")):
        assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in back.collect()) == want
    places.unpersist()
    root.unpersist()
    none = pages.limit(0)
    places = warc.write_archives(none, f"file://{tmp_path}/b")
    root = warc.build_index(places, f"file://{tmp_path}/j")
    assert warc.CaptureIndex(root, f"file://{tmp_path}/j", f"file://{tmp_path}/b").lookup("http://a.com/") == []
    assert warc.fetch(warc.resolve(warc.capture_keys(none), root, f"file://{tmp_path}/j"), f"file://{tmp_path}/b").count() == 0
