"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from quadra.llm import decontaminate, graph, hmm, line_dedup, media_tiff, minhash, mixing, packing, pii, quality, warc
from quadra.llm.bytestok import ALNUM, BLANK_SPLIT, utf8, words
from quadra.llm.store import Workspace

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def alnum_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\x0b\x1f.,é😀İ", max_size=30)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts: list) -> None:
    data, offsets = utf8(pa.array(texts, pa.string()))
    for keep, brute in ((BLANK_SPLIT, blank_words), (ALNUM, alnum_words)):
        got = words(data, offsets, keep)
        for i, t in enumerate(texts):
            spans = range(got.first[i], got.first[i + 1])
            assert [bytes(got.data[got.starts[k] : got.ends[k]]).decode() for k in spans] == brute(t)
    seen: dict[int, bytes] = {}
    for k, h in enumerate(got.hashes.tolist()):
        w = bytes(got.data[got.starts[k] : got.ends[k]])
        assert seen.setdefault(h, w) == w


# 1

def test_quality_held_out(spark: SparkSession) -> None:
    d = "/root/testdata/sf0.01"
    r = quality.op1_quality_classifier(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97
    assert r.score.between(0, 1).all() and ((r.score >= 0.3) == (r.predicted == 1)).all()


def test_quality_exact_neighbours() -> None:
    rng = np.random.default_rng(1)
    x, y = rng.random((60, 8)).astype(np.float32), rng.integers(0, 2, 60)
    space = quality.Space(x, y, 4)
    got = space.score(x[:9], 5, 8.0)
    p = space.project(x)
    for i in range(9):
        near = sorted(range(60), key=lambda j: -float(p[i] @ p[j]))[:5]
        w = [max(float(p[i] @ p[j]), 0) ** 8 + 1e-9 for j in near]
        assert got[i] == pytest.approx(sum(a * y[j] for a, j in zip(w, near, strict=True)) / sum(w), abs=1e-4)


def test_quality_vectors() -> None:
    """Terms of each text, counted by loops."""
    def kind(b: int) -> int:
        c = chr(b)
        marks = [chr(x) for x in range(33, 127) if not chr(x).isalnum()]
        if "A" <= c <= "Z":
            return 1
        if "0" <= c <= "9":
            return 2
        if c in " \n":
            return 3 if c == " " else 4
        return 5 + marks.index(c) if c in marks else 5 + len(marks) if b < 32 or b == 127 else 0

    texts = [None, "", "a", "The the THE cat, sat 12\tx\n" * 3, "é!? word Word the \x7f", "x y z x y z"]
    data, offsets = utf8(pa.array(texts))
    got = quality._vectors(data, offsets)
    for row, t in zip(got, texts, strict=True):
        want, raw, w = np.zeros(quality.TERMS), (t or "").encode(), blank_words(t)
        for x, y in zip(raw, raw[1:], strict=False):
            want[kind(x) * quality._K + kind(y)] += 1 / (len(raw) - 1)
        for x in w:
            h = int(words(*utf8(pa.array([x])), BLANK_SPLIT).hashes[0])
            want[quality._WORDS + (h >> 40) % quality.WORDS] += quality._WORD / len(w)
        if w:
            grams = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
            rates = [sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w) - 1), 1 - len(grams) / max(1, len(w) - 2), 1 - len(set(w)) / len(w)]
            for r, rate in enumerate(rates):
                want[quality._RATES + 8 * r + min(7, int(rate * 8))] = quality._RATE
        assert np.allclose(row, np.sqrt(want), atol=1e-6)


def test_quality_leaves_itself_out(spark: SparkSession) -> None:
    """A document's own label never moves its score; a sole teacher scores itself 0.5; ties go to smaller ids."""
    random.seed(4)
    docs = spark.createDataFrame([(i, " ".join(random.choices(["alpha", "beta", "Gamma!", "7"], k=9))) for i in range(40)], "doc_id long, text string")
    label = {i: i % 2 for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    scores = []
    for flipped in (None, 3, 8):
        labels = spark.createDataFrame([(i, y ^ (i == flipped)) for i, y in label.items()], "doc_id long, quality int")
        scores.append({r["doc_id"]: r["score"] for r in quality.score(docs, labels, dims=6, neighbours=5).collect()})
    for flipped, got in ((3, scores[1]), (8, scores[2])):
        assert flipped in label and got[flipped] == scores[0][flipped] and got != scores[0]
    alone = quality.score(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"), dims=6).collect()
    assert {r["score"] for r in alone if r["doc_id"] == 3} == {0.5} and {r["score"] for r in alone if r["doc_id"] != 3} == {1.0}
    space = quality.Space(np.ones((6, 4), np.float32), np.array([1, 1, 0, 0, 0, 0]), 2)
    assert space.score(np.ones((1, 4), np.float32), 2, 8.0).tolist() == [1.0]


# 2

def brute_contamination(docs: dict, items: dict, window: int = 10) -> dict:
    wins = defaultdict(set)
    for i, t in items.items():
        w = alnum_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs.items():
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def brute_longest(docs: dict, items: dict, window: int = 10) -> dict:
    out = {}
    for d, t in docs.items():
        w, best = alnum_words(t), (0, None, None)
        for i, u in items.items():
            x = alnum_words(u)
            for a in range(len(w)):
                for b in range(len(x)):
                    n = 0
                    while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                        n += 1
                    if n >= min(window, len(x)):
                        best = min(best, (-n, str(i), a), key=lambda y: (y[0], y[1] or "", y[2] or 0))
        out[d] = (-best[0], best[1], best[2])
    return out


@pytest.mark.parametrize("slice_words", [25, 10**6])
def test_contamination(spark: SparkSession, slice_words: int) -> None:
    random.seed(2)
    say = lambda n: " ".join(random.choice("abcd") for _ in range(n))
    docs = {i: say(random.choice([0, 3, 40, 400])) for i in range(60)} | {100: None, 101: ""}
    items = {i: say(random.choice([2, 5, 11, 14])) for i in range(12)} | {50: None, 51: "Z"}
    docs[7] = f"x {items[0].upper()}, y"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert len(decontaminate.write_slices(b, 6, slice_words=slice_words).files) == (1 if slice_words > 25 else 4)
    rows = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(d, b, window=6, keep=["doc_id"], slice_words=slice_words).collect()}
    assert {k: v[:5] for k, v in rows.items()} == brute_contamination(docs, items, 6)
    assert {k: v[5:] for k, v in rows.items()} == brute_longest(docs, items, 6)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(d, b, 6).collect()}
    assert kept == {k for k, v in rows.items() if not v[4]}


def test_longest_matches(spark: SparkSession) -> None:
    d = spark.createDataFrame([(1, "q a b c d e f q"), (2, "b c d e x a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "a b c d e f g")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.matches(d, b, window=4).collect()}
    assert got == {(1, "9", 0, 1, 6), (2, "9", 1, 0, 4)} or got == {(1, "9", 0, 1, 6)}


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_suffix_array(xs: list, depth: int) -> None:
    rank = np.array([*xs, 0])
    sa = decontaminate.suffix_array(rank, depth)
    cut = [tuple(rank[i : i + depth]) for i in sa]
    assert cut == sorted(cut) and sorted(sa) == list(range(len(rank)))


# 3

@given(st.binary(min_size=1, max_size=3000), st.sampled_from([1, 5, 8, 32773]), st.sampled_from([1, 2]), st.sampled_from("<>"), st.sampled_from([0, 16]))
@settings(max_examples=150, deadline=None)
def test_tiff_round_trip(raw: bytes, kind: int, predictor: int, order: str, tile: int) -> None:
    payload = media_tiff.text_payload(raw)
    media = media_tiff.encode(payload, compression=kind, predictor=predictor, order=order, tile=tile, page_rows=16, strip_rows=5)
    found = list(media_tiff.pages(media))
    assert b"".join(p["pixels"] for p in found) == payload and len(found) == -(-len(payload) // (64 * 16))


def test_tiff_float_predictor() -> None:
    x = np.random.default_rng(0).random((3, 5)).astype("<f4")
    planes = x.astype(">f4").view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    stored = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    assert media_tiff._unpredict(stored, 3, 3, 5, 1, 32, "<") == x.tobytes()


def by_hand(order: str, tags: list[tuple], data: bytes = b"", big: bool = False) -> bytes:
    """A file as another writer lays it out: the data first, then one directory; values of tags are given packed.

    A tag is (number, kind, count, packed value or place of it)."""
    word, entry = ("Q", "HHQ8s") if big else ("I", "HHI4s")
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16 + len(data)) if big else struct.pack(order + "HI", 42, 8 + len(data)))
    ifd = struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(struct.pack(order + entry, *t) for t in tags) + struct.pack(order + word, 0)
    return head + data + ifd


def short(order: str, n: int) -> bytes:
    return struct.pack(order + "H", n)


def long(order: str, n: int) -> bytes:
    return struct.pack(order + "I", n)


def test_tiff_samples_of_the_format() -> None:
    """The worked samples of the published format: a PackBits stream and an LZW code sequence."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media_tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")[:24]
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media_tiff.lzw_decode(stream, 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and media_tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_tiff_of_another_writer(order: str, big: bool) -> None:
    """RGB of 16 bits with predictor 2, two strips, text tags and long tags in any order of kinds; also big files."""
    x = np.random.default_rng(2).integers(0, 2**16, (3, 4, 3)).astype(np.uint16)
    d = np.diff(x, axis=1, prepend=np.zeros((3, 1, 3), np.uint16)).astype(order + "u2")
    strips = [zlib.compress(d[:2].tobytes()), zlib.compress(d[2:].tobytes())]
    at = 16 if big else 8
    data = strips[0] + strips[1]
    s = lambda n: short(order, n)
    more = data + struct.pack(order + "3H", 16, 16, 16) + struct.pack(order + "2I", at, at + len(strips[0])) + struct.pack(order + "2I", *map(len, strips)) + b"a writer\0"
    place = lambda n: struct.pack(order + ("Q" if big else "I"), at + len(data) + n)
    inline = lambda n, raw: raw if big else place(n)
    tags = [(256, 3, 1, s(4)), (257, 4, 1, long(order, 3)), (258, 3, 3, inline(0, struct.pack(order + "3H", 16, 16, 16))), (259, 3, 1, s(8)), (262, 3, 1, s(2)),
            (273, 4, 2, inline(6, struct.pack(order + "2I", at, at + len(strips[0])))), (277, 3, 1, s(3)), (278, 3, 1, s(2)), (279, 4, 2, inline(14, struct.pack(order + "2I", *map(len, strips)))), (305, 2, 9, place(22)), (317, 3, 1, s(2)), (270, 2, 0, b"")]
    (page,) = media_tiff.pages(by_hand(order, tags, more, big))
    assert np.frombuffer(page["pixels"], order + "u2").reshape(3, 4, 3).tolist() == x.tolist()


@pytest.mark.parametrize("change", [
    {324: None}, {325: None}, {256: (256, 3, 0, b"")}, {256: (256, 2, 4, b"abc\0")}, {256: (256, 4, 1, b"\xff\xff\xff\x7f"), 257: (257, 4, 1, b"\xff\xff\xff\x7f")},
    {322: (322, 4, 1, b"\xff\xff\xff\x7f")}, {258: (258, 3, 1, b"\1\0")}, {259: (259, 3, 1, b"\7\0")}, {317: (317, 3, 1, b"\3\0")}, {324: (324, 4, 1, b"\xff\xff\0\0")}, {256: (256, 11, 1, b"\0\0\x80\x3f")}, {256: (256, 9, 1, b"\xff\xff\xff\xff")}])
def test_tiff_damaged(change: dict) -> None:
    good = {256: (256, 3, 1, b"\x10\0"), 257: (257, 3, 1, b"\x10\0"), 258: (258, 3, 1, b"\x08\0"), 259: (259, 3, 1, b"\1\0"), 322: (322, 4, 1, b"\x10\0\0\0"), 323: (323, 4, 1, b"\x10\0\0\0"), 324: (324, 4, 1, b"\x08\0\0\0"), 325: (325, 4, 1, b"\0\1\0\0")}
    data = bytes(range(256))
    (page,) = media_tiff.pages(by_hand("<", list(good.values()), data))
    assert page["pixels"] == data
    with pytest.raises(media_tiff.TiffError):
        list(media_tiff.pages(by_hand("<", [t for t in (good | change).values() if t], data)))


@given(st.data())
@settings(max_examples=300, deadline=None)
def test_tiff_never_fails_otherwise(data) -> None:
    """Bytes changed or cut anywhere: pages, or a TiffError."""
    form = {"compression": data.draw(st.sampled_from([1, 5, 8, 32773])), "predictor": data.draw(st.sampled_from([1, 2])), "tile": data.draw(st.sampled_from([0, 16])), "order": data.draw(st.sampled_from("<>"))}
    raw = bytearray(media_tiff.encode(bytes(range(64)) * 40, page_rows=16, strip_rows=5, **form))
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(4, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = raw[: data.draw(st.integers(0, len(raw)))] if data.draw(st.booleans()) else raw
    try:
        assert all(len(p["pixels"]) <= media_tiff.EXPANSION * (len(raw) + 1) for p in media_tiff.pages(bytes(raw)))
    except media_tiff.TiffError:
        pass


def test_tiff_pages(spark: SparkSession) -> None:
    good = media_tiff.encode(bytes(64 * 40), page_rows=16)
    huge = by_hand("<", [(256, 4, 1, b"\xff\xff\xff\x7f"), (257, 4, 1, b"\xff\xff\xff\x7f"), (258, 3, 1, b"\x08\0"), (322, 3, 1, b"\x10\0"), (323, 3, 1, b"\x10\0")])
    rows = [(1, good, "a"), (2, b"junk", "b"), (3, None, "c"), (4, good[:60], "d"), (5, huge, "e"), (6, good, "f")]
    got = media_tiff.read_pages(spark.createDataFrame(rows, "id int, media binary, page string")).collect()
    assert Counter(r["id"] for r in got) == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 3}
    assert [r["height"] for r in got if r["id"] == 1] == [16, 16, 8] and all(bool(r["error"]) == (r["id"] not in (1, 6)) for r in got)


def test_text_media(spark: SparkSession) -> None:
    """Every column of the query; the mean and entropy from the text itself, the form from the stored tags."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text, seen = {r["doc_id"]: r["text"] for r in docs.collect()}, set()
    for r in media_tiff.op3_media_tiff(spark, SF).collect():
        raw = text[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        form = media_tiff.form_of(payload)
        media = media_tiff.encode(payload, page_rows=256, strip_rows=64, **form)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        share = [n / len(payload) for n in Counter(payload).values()]
        got = dict(x.split("=") for x in r["feature"].split(";"))
        assert float(got["mean"]) == pytest.approx(sum(payload) / len(payload), abs=1e-4) and float(got["entropy"]) == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-4)
        assert (int(got["pages"]), int(got["rows"])) == (-(-len(payload) // (64 * 256)), len(payload) // 64)
        assert (int(got["compression"]), int(got["predictor"])) == (form["compression"], form["predictor"])
        seen.add(tuple(form.values()))
    assert len(seen) >= 30


# 4

def luhn(d: str) -> bool:
    return sum(n if i % 2 == 0 else n * 2 - 9 if n > 4 else n * 2 for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t: str | None) -> list:
    def passes(kind: str, h: str) -> bool:
        digits = re.sub("[^0-9]", "", h)
        if kind == "ip":
            return all(int(p) <= 255 for p in h.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(pii.BASE_PATTERNS[kind], t or "") if passes(kind, m.group()))


def test_base_spans(spark: SparkSession) -> None:
    random.seed(5)
    odd = ["".join(random.choice("a1.@-+ 4()%_é😀\n") for _ in range(random.randrange(80))) for _ in range(1500)]
    odd += ["a@b.c_d@e.f", "4111 1111 1111 1111", "4111-1111-1111-1111-", "1.2.3.4.5.6.7.8", "+1 (974) 555-3436+1 974 555 3436", "1 " * 4000, "a" * 100_000 + "@ b@c.d", "0001.2.3.255 1.2.3.256", None]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.personal_data(d).collect():
        assert [tuple(x) for x in r["base"]] == brute_base(odd[r["doc_id"]]), odd[r["doc_id"]][:100]
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}


def brute_pii(texts: list, confidence: float = 0.6, rounds: int = 4, least_seeds: int = 3) -> tuple[list, dict]:
    """Base and all spans of each text, and the trusted patterns, by plain loops."""
    gap = " \t\n\x0b\x0c\r\"'`=:;,|()[]{}<>"
    word = f"[^{re.escape(gap)}]+"
    counts = Counter(w.lower() for t in texts for w in re.findall(word, t or ""))
    base, found, edges = [], [], Counter()
    seeds = set()
    for row, t in enumerate(texts):
        t = t or ""
        words_ = [m.span() for m in re.finditer(word, t)]
        base.append(brute_base(t))

        def beside(a: int, b: int, t=t, words_=words_) -> list[str]:
            left = [t[x:y].lower() for x, y in words_ if y <= a and not (y == a)]
            right = [t[x:y].lower() for x, y in words_ if x >= b and not (x == b)]
            return [f"L|{left[-1]}" if left else "", f"R|{right[0]}" if right else ""]

        def note(a: int, b: int, value: str, seed: bool, new: bool, at: tuple, row=row) -> None:
            if seed:
                seeds.add(value)
            for p in beside(*at):
                if p:
                    edges[p, value] += 1
                    found.append((row, a, b, p, new))

        core = lambda h: (re.match(r"(?s)[^A-Za-z0-9]*(.*[A-Za-z0-9])", h) or [h, ""])[1]
        for a, _, b in base[-1]:
            note(a, b, core(t[a:b]), True, False, (a, b))
        tokens = [m.span() for m in re.finditer(word, t) if re.search("[0-9]", m.group())]
        for kind in ("card", "phone"):
            tokens += [m.span() for m in re.finditer(pii.BASE_PATTERNS[kind], t) if " " in m.group() and (m.start(), pii.KINDS.index(kind), m.end()) not in base[-1]]
        for a, b in tokens:
            h = t[a:b]
            lead = len(h) - len(re.sub("^[^A-Za-z0-9]+", "", h))
            x, y = a + lead, a + lead + len(core(h))
            if not any(p < y and x < q for p, _, q in base[-1]):
                secret = re.fullmatch(r"[0-9A-Za-z]{20,}", core(h)) and len(re.findall("[A-Za-z]", core(h))) >= 4 and len(re.findall("[0-9]", core(h))) >= 4
                note(x, y, core(h), bool(secret), True, (a, b))
    scores = dict.fromkeys(seeds, 1.0)
    for r in range(rounds):
        trusted = {}
        for p in {p for p, _ in edges}:
            mine = [v for q, v in edges if q == p]
            bad = max(0, counts[p[2:]] - sum(n for (q, _), n in edges.items() if q == p))
            conf = sum(scores.get(v, 0) for v in mine) / (len(mine) + bad + 1)
            if sum(scores.get(v, 0) >= pii.SURE for v in mine) >= least_seeds and conf >= confidence:
                trusted[p] = conf
        if r < rounds - 1:
            miss = defaultdict(float)
            for p, v in edges:
                if p in trusted:
                    miss[v] += math.log(1 - min(trusted[p], 0.999))
            scores = {v: 1 - math.exp(m) for v, m in miss.items()} | dict.fromkeys(seeds, 1.0)
    spans = [sorted({*b, *((a, 4, e) for row, a, e, p, new in found if row == i and new and p in trusted)}) for i, b in enumerate(base)]
    return list(zip(base, spans, strict=True)), trusted


def chance_texts() -> list:
    """Values of many kinds in contexts that are often, sometimes or hardly ever beside them."""
    random.seed(15)
    value = [lambda: f"10.0.{random.randrange(9)}.{random.randrange(99)}", lambda: f"u{random.randrange(60)}@b.cc", lambda: f"N-{random.randrange(30)}", lambda: "+1 (974) 555-34%02d" % random.randrange(99), lambda: f"{random.randrange(10**6)} {random.randrange(99)}", lambda: hashlib.sha1(bytes([random.randrange(40)])).hexdigest(), lambda: f"300.1.2.{random.randrange(9)}", lambda: "plain"]
    out = []
    for _ in range(400):
        k = random.randrange(6)
        v = value[random.choice([k, k, k, (k + 1) % 8, 7] if k != 3 else [7, 2, 0])]()
        out.append(f"{random.choice('abc')} key{k}{random.choice([' ', '=', ': ', ' (', ' = chr '])}{v}{random.choice([' ', ') ', ', '])}{random.choice(['end', f'then{k}', '7'])}")
    return out + [None, "", "key0", "1.2.3.4", "x1.2.3.4y key1=z9@a.bb5", "key0 4111 1111 1111 1112, key0 12 3456", "K" * 30_000 + "7 then1 " + "9" * 5000]


@pytest.mark.parametrize("rounds", [1, 4])
def test_extraction_against_loops(spark: SparkSession, monkeypatch, rounds: int) -> None:
    texts, kept = chance_texts(), {}
    plain = pii.trusted_patterns
    monkeypatch.setattr(pii, "trusted_patterns", lambda *a, **k: kept.setdefault("p", plain(*a, **k)))
    want, trusted = brute_pii(texts, rounds=rounds)
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), rounds=rounds).collect()}
    assert {r["pattern"]: pytest.approx(r["confidence"]) for r in kept["p"].collect()} == trusted and len(trusted) >= 3
    for i, (base, spans) in enumerate(want):
        assert [tuple(x) for x in got[i]["base"]] == base and [tuple(x) for x in got[i]["spans"]] == spans, texts[i]


def test_op4_columns(spark: SparkSession, tmp_path) -> None:
    """The digest columns of the query, from the same loops."""
    texts = chance_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = brute_pii(texts)
    names = (*pii.KINDS, "context")
    say = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    found = pii.op4_pii(spark, str(tmp_path)).collect()
    assert len(found) == len(texts) and sum(r["n_context"] for r in found) == sum(len(b) - len(a) for a, b in want) > 10
    for r in found:
        base, spans = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(say(base).encode()).hexdigest() and r["spans"] == say(spans)
        assert (r["n_spans"], r["n_context"]) == (len(spans), len(spans) - len(base))


def context_values(spark: SparkSession, texts: list[str], **parameters) -> dict[int, set[str]]:
    found = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **parameters).collect()
    return {r["doc_id"]: {texts[r["doc_id"]][a:b] for a, k, b in r["spans"] if k == 4} for r in found}


def test_bootstrapping(spark: SparkSession) -> None:
    """Badge codes, which no base pattern knows: those beside a seed's word are promoted in round 1, and induce a
    pattern without any seed, which finds others in round 2; ordinary words beside a pattern speak against it."""
    texts = [f"node 10.0.0.{i} up" for i in range(30)] + [f"node NX-{i} up" for i in range(4)]
    texts += [f"badge NX-{i} lost" for i in range(4)] + ["badge QQ77 lost", "item QQ78 sold"]
    texts += [f"the 10.0.1.{i} host" for i in range(5)] + ["the plain words the other the end"] * 3 + ["the 12345 thing"]
    once, twice = (context_values(spark, texts, rounds=r) for r in (1, 4))
    assert once[33] == twice[33] == {"NX-3"}
    assert (once[38], twice[38]) == (set(), {"QQ77"})
    assert twice[39] == twice[len(texts) - 1] == set()


def test_secrets_teach(spark: SparkSession) -> None:
    """The word before secrets finds one of another form, whatever joins them."""
    texts = [f'in token = "{hashlib.sha1(bytes([i])).hexdigest()}" of {i}' for i in range(9)] + ["say token: hunter2 now", "digest 0123456789abcdef0123 stands alone", "token of words"]
    got = context_values(spark, texts)
    assert got[9] == {"hunter2"} and got[10] == got[11] == set() and got[0] == {hashlib.sha1(b"\0").hexdigest()}


def test_common_words_are_not_trusted(spark: SparkSession) -> None:
    """On real tables no pattern is a common word, and what is found beside base spans are secrets."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    secret = re.compile(r'token = "([0-9a-f]{40})"', re.I)
    found = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark, folder).collect()}
    for i, t in texts.items():
        got = {t[int(a) : int(b)] for k, a, b in (x.split(":") for x in found[i].split(",") if x) if k == "context"}
        assert got == set(secret.findall(t))


def test_words_beside(spark: SparkSession) -> None:
    random.seed(6)
    texts = ["".join(random.choice("a1.@ =\n,é") for _ in range(random.randrange(60))) for _ in range(400)] + ["x1 " * 700]
    d = pii._find(spark.createDataFrame([(x,) for x in texts], "text string"), "text", "hits", "[0-9]++", pii._may_hold(pii.F.col("text"), "ip"))
    for r in d.collect():
        spans = [m.span() for m in re.finditer(r"[^ =,\n]+", r["text"])]
        for x in r["hits"]:
            k = next(k for k, (a, b) in enumerate(spans) if a <= x["start"] and x["end"] <= b)
            beside = [r["text"][slice(*spans[j])] if 0 <= j < len(spans) else "" for j in (k - 1, k + 1)]
            assert [x["left"], x["right"]] == beside and r["text"][x["start"] : x["end"]] == x["hit"]


# 5

def plain_hmm(model: hmm.Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of one sequence and its log likelihood, step by step."""
    k, width = model.emit.shape
    alpha, scale = np.zeros((len(x), k)), np.zeros(len(x))
    for t, c in enumerate(x):
        a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[:, c]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta = np.ones((len(x), k))
    pairs, emissions = np.zeros((k, k)), np.zeros((k, width))
    for t in range(len(x) - 1, -1, -1):
        if t + 1 < len(x):
            ahead = model.emit[:, x[t + 1]] * beta[t + 1] / scale[t + 1]
            pairs += alpha[t][:, None] * model.move * ahead[None, :]
            beta[t] = model.move @ ahead
        emissions[:, x[t]] += alpha[t] * beta[t]
    return alpha[0] * beta[0], pairs, emissions, float(np.log(scale).sum())


def test_hmm_paths() -> None:
    """The step-by-step version agrees with the sum over all paths of states."""
    rng = np.random.default_rng(3)
    k, x = 2, np.array([0, 3, 1, 4])
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(5), k))
    total, first, pairs, emissions = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, 5))
    for path in np.ndindex(*([k] * len(x))):
        p = model.start[path[0]] * model.emit[path[0], x[0]]
        for a, b, c in zip(path, path[1:], x[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, c]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += p
        for s, c in zip(path, x, strict=True):
            emissions[s, c] += p
    for a, b in zip(plain_hmm(model, x), (first / total, pairs / total, emissions / total, math.log(total)), strict=True):
        assert np.allclose(a, b)


@pytest.mark.parametrize("tokens", [40, 10**6])
def test_hmm_expected_counts(monkeypatch, tokens: int) -> None:
    """Texts of all lengths about the span's, whole: counts and likelihoods of long ones carry over spans."""
    monkeypatch.setattr(hmm, "SPAN", 16)
    monkeypatch.setattr(hmm, "PASS_TOKENS", tokens)
    rng = np.random.default_rng(1)
    k, width = 3, 7
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(width), k))
    lengths = np.array([1, 5, 16, 17, 32, 33, 100, 2, 250])
    symbols = rng.integers(0, width, lengths.sum())
    want = [plain_hmm(model, x) for x in np.split(symbols, np.cumsum(lengths)[:-1])]
    assert np.allclose(hmm.log_likelihoods(model, symbols, lengths), [w[3] for w in want], rtol=1e-6)
    for got, w in zip(hmm.expected_counts(model, symbols, lengths), zip(*want, strict=True), strict=True):
        assert np.allclose(got, sum(w), rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("common", [65_536, 30])
def test_hmm_every_score(spark: SparkSession, monkeypatch, common: int) -> None:
    """Every score against a model trained step by step over whole texts, with words as symbols and with classes."""
    monkeypatch.setattr(hmm, "COMMON", common)
    random.seed(12)
    vocab = [f"{random.choice('abc')}{i}{random.choice(['ing', 'ed', 'x', 'ly and'])}" for i in range(60)]
    docs = {i: " ".join(random.choices(vocab, weights=range(1, 61), k=n)) for i, n in enumerate([3, 40, 5, 200, 0, 1, 2600, 1100, 30, 9, 17, 60])} | {20: None, 21: "never seen words"}
    states, rounds = 3, 2
    toks = {i: [*blank_words(t), None] for i, t in docs.items()}
    train = {i: t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(w for t in train.values() for w in t)
    n, v = sum(counts.values()), len(counts)

    def of(w: str | None) -> tuple[int, int]:
        if w is None:
            return hmm._END_HASH.astype(np.int64).item(), hmm.END
        got = words(*utf8(pa.array([w])), BLANK_SPLIT)
        return got.hashes.astype(np.int64).item(), int(hmm.word_classes(got.data, got.starts, got.ends)[0])

    place = {w: of(w) for t in toks.values() for w in t}
    known = sorted(place[w][0] for w in counts if counts[w] * common >= n)
    symbol = {w: hmm.CLASSES + known.index(h) if h in known else c for w, (h, c) in place.items()}
    mass = np.zeros(hmm.CLASSES + len(known))
    for w, c in counts.items():
        mass[symbol[w]] += c + 0.5
    share = mass / mass.sum()
    model = hmm.Model.random(states, share)
    for _ in range(rounds):
        got = [plain_hmm(model, np.array([symbol[w] for w in t])) for t in train.values()]
        model = hmm.Model.of_counts(*(sum(x) for x in list(zip(*got, strict=True))[:3]), share)
    below = n + 0.5 * (v + 1)
    r = hmm.score(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), states, rounds, tolerance=0.0).collect()
    assert len(r) == len(docs) and len(known) < v if common == 30 else len(known) == v
    for x in r:
        t = toks[x["doc_id"]]
        a, total = None, 0.0
        for w in t:
            p = (1 - 0.5 / below) * (counts[w] + 0.5) / below / (mass[symbol[w]] / below) * model.emit[:, symbol[w]] if counts[w] else np.full(states, 0.5 / below)
            a = (model.start if a is None else a @ model.move) * p
            total += math.log10(a.sum())
            a = a / a.sum()
        base = sum(math.log10((counts[w] + 0.5) / below) for w in t)
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (x["doc_id"] not in train, len(t), sum(counts[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(base, rel=1e-9) and x["score"] == pytest.approx(total, rel=1e-3)


def test_hmm_scores(spark: SparkSession) -> None:
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    r = hmm.score(spark.read.parquet(f"{SF}/documents.parquet"), states=4, rounds=4).toPandas()
    toks = {i: [*blank_words(t), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for x in r.itertuples():
        t = toks[x.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(base, rel=1e-9)
    h = r[r.held_out]
    assert h.score.sum() > h.base_score.sum() * 0.99, "the model must predict unseen texts better than word counts do"


# 6

def brute_components(docs: dict, width: int, percent: int) -> dict:
    def shingles(t: str | None) -> set:
        w = blank_words(t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 85)])
def test_near_small_sets(spark: SparkSession, width: int, percent: int) -> None:
    """Pairs of few shingles at the bound itself: a word more at the end."""
    least = -(-percent // (100 - percent))
    docs = {}
    for i in range(400):
        w = [f"p{i}w{j}" for j in range(width + least - 1 + i % 3 * 5)]
        docs |= {2 * i: " ".join(w), 2 * i + 1: " ".join([*w, "more"])}
    found = minhash.groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), width, percent).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found)


@pytest.mark.parametrize(("width", "percent", "block", "part"), [(3, 85, 2000, 1000), (5, 80, 20, 10)])
def test_near_duplicates(spark: SparkSession, monkeypatch, width: int, percent: int, block: int, part: int) -> None:
    """Families of edited copies over a range of similarities, a shared passage, tiny texts; also with tiny blocks and parts."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)
    monkeypatch.setattr(minhash, "DELEGATES", 2)
    monkeypatch.setattr(minhash, "LIST_PART", part)
    random.seed(8)
    vocab = [f"w{i}" for i in range(3000)]
    docs, passage = {}, " ".join(random.choices(vocab, k=60))
    for family in range(8):
        base = random.choices(vocab, k=random.choice([12, 60, 200, 500]))
        for copy in range(25):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, len(w) // 30])):
                w[random.randrange(len(w))] = random.choice(vocab)
            docs[len(docs)] = " ".join(w)
    for _ in range(60):
        docs[len(docs)] = " ".join(random.choices(vocab, k=200)) + " " + passage
    for t in ("", None, "a", "a", "a b", "A  b", "a b c d e f g", "a b c d e f g h"):
        docs[len(docs)] = t
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(d, width, percent).collect()}
    assert got == brute_components(docs, width, percent)


@given(st.integers(0, 10**6), st.booleans(), st.booleans())
@settings(max_examples=60, deadline=None)
def test_exact_links(seed: int, sided: bool, known: bool) -> None:
    """The links of each set of sets, by pairs; sides and known components as given."""
    rng = random.Random(seed)
    base = [rng.sample(range(400), 30) for _ in range(3)]
    sets = [np.unique(np.array([rng.choice([v, v, v, v, v, v, v, v, rng.randrange(400)]) for v in rng.choice(base)], np.uint64)) for _ in range(30)]
    nodes = np.array(rng.sample(range(1000), 30))
    left = np.array([rng.random() < 0.4 for _ in sets]) if sided else None
    comp = np.array([rng.randrange(20) for _ in sets]) if known else np.arange(30)
    got = minhash.exact_links(nodes, sets, left, 80, comp if known else None)

    def roots(edges: list) -> list[int]:
        parent = list(range(30))

        def root(x: int) -> int:
            return x if parent[x] == x else root(parent[x])

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        return [root(x) for x in range(30)]

    same = [(i, j) for i in range(30) for j in range(i) if comp[i] == comp[j]]
    link = [(i, j) for i in range(30) for j in range(30) if i != j and (not sided or left[i] and not left[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    at = {int(x): i for i, x in enumerate(nodes)}
    assert roots(same + [(at[a], at[b]) for a, b in got]) == roots(same + link) and len(got) < 30


def test_components(spark: SparkSession) -> None:
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, i) for i in range(201, 260)] + [(300 + random.randrange(60), 300 + random.randrange(60)) for _ in range(50)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x: int) -> int:
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_lists_of_a_family_share_edges() -> None:
    """Lists that hold most of one family give nearly the same edges, in whatever order their members come."""
    rng = np.random.default_rng(6)
    base = np.sort(rng.integers(0, 2**63, minhash.K, dtype=np.uint64))
    nodes = rng.choice(10**6, 200, replace=False)
    sketch = [np.unique(np.where(rng.random(minhash.K) < 0.02, rng.integers(0, 2**63, minhash.K, dtype=np.uint64), base)) for _ in nodes]
    found = set()
    for _ in range(40):
        at = rng.permutation(np.flatnonzero(rng.random(200) < 0.7))
        edges, _ = minhash.clumps(nodes[at], [sketch[i] for i in at], np.full(len(at), 100), minhash.LOOSE)
        assert len(edges) == len(at) - 1 and {x for e in edges for x in e} == set(nodes[at].tolist())
        found |= {(max(e), min(e)) for e in edges}
    assert len(found) < 10 * len(nodes)


def generated_rows(spark: SparkSession, seen: set) -> int:
    """Rows that Generate nodes made in executions not yet seen."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run in seen:
            continue
        seen.add(run)
        nodes = store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate":
                value = store.executionMetrics(run).get(node.metrics().apply(0).accumulatorId())
                rows += int(value.get().replace(",", "")) if value.isDefined() else 0
    return rows


@pytest.mark.parametrize("rows", [100, 4000, 200_000])
def test_components_in_parts(spark: SparkSession, monkeypatch, rows: int) -> None:
    """A family that is linked many times over, a path and random edges, by parts of any size."""
    monkeypatch.setattr(graph, "PART_ROWS", rows)
    rng = random.Random(9)
    edges = [(x, hub) for hub in range(0, -40, -1) for x in range(1, 301)] + [(i, i + 1) for i in range(1000, 1300)]
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(140)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "u long, v long").repartition(4)
    seen: set = set()
    generated_rows(spark, seen)
    got = {r["node"]: r["root"] for r in graph.components(table, Workspace(spark, "t")).collect()}
    made = generated_rows(spark, seen)
    parent = {x: x for e in edges for x in e}

    def root(x: int) -> int:
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    # the 12,000 edges of the family are not doubled in a round where parts hold more edges than it has nodes
    assert rows == 100 or made < len(edges)


# 7

def plain_best_fit(counts: dict, row_len: int) -> list[int]:
    """Free spaces of the rows, packing one piece at a time."""
    spaces: list[int] = []
    for n in sorted((n for n, m in counts.items() for _ in range(m)), reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
        spaces.append((min(fits) if fits else row_len) - n)
    return sorted(spaces)


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_best_fit(counts: dict) -> None:
    """The plan of counts is that of single pieces, and gives every piece a place of its own."""
    made = packing.plan(counts, 32)
    used = np.zeros((made.n_rows, 32), int)
    for n, m in counts.items():
        row, at = made.find(n, np.arange(m))
        for r, a in zip(row, at, strict=True):
            assert a + n <= 32
            used[r, a : a + n] += 1
    assert (used <= 1).all() and sorted((32 - used.sum(1)).tolist()) == plain_best_fit(counts, 32)
    ends = used.sum(1)
    assert all(used[r, : ends[r]].all() for r in range(made.n_rows))


def test_packing(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(9000 + i, t, None, None, None) for i, t in enumerate(["", None, "one"])], docs.schema))
    enc = packing.encoding(packing.load_vocabulary(packing.VOCABULARY))
    text = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    length = Counter()
    for (_, t), m in text.items():
        n = len(enc.encode_ordinary(t))
        length[256] += n // 256 * m
        length[n % 256] += m
    want = plain_best_fit({n: m for n, m in length.items() if n and m}, 256)
    for parts in (1, 7):
        rows = packing.packed_rows(docs.repartition(parts), row_len=256).collect()
        assert sorted(256 - r["n_tokens"] for r in rows) == want and sorted(r["row_id"] for r in rows) == list(range(len(want)))
        found, empty = defaultdict(list), Counter()
        for r in rows:
            ids = np.frombuffer(r["ids"], "<u2")
            assert len(ids) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 50256).all()
            where = packing.position_ids(r["resets"], r["n_tokens"])
            empty.update(r["empty_ids"])
            for k, d in enumerate(zip(r["doc_ids"], r["doc_rows"], strict=True)):
                a, b = r["cu_seqlens"][k : k + 2]
                assert where[a] == 0 and where[b - 1] == b - a - 1
                found[d].append((r["starts"][k], ids[a:b]))
        back = Counter()
        for (d, _), x in found.items():
            x.sort(key=lambda p: p[0])
            assert [p[0] for p in x] == [256 * k for k in range(len(x))]
            back[d, enc.decode(np.concatenate([p[1] for p in x]).tolist())] += 1
        assert back + Counter({(d, ""): m for d, m in empty.items()}) == text


def test_empty_documents_have_rows(spark: SparkSession, monkeypatch) -> None:
    monkeypatch.setattr(packing, "EMPTIES", 4)
    rows = packing.packed_rows(spark.createDataFrame([(i, None if i % 2 else "") for i in range(9)] + [(50, "a")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and max(len(r["empty_ids"]) for r in rows) <= 4 and sorted(d for r in rows for d in r["empty_ids"]) == list(range(9))


def test_long_text_tokens(monkeypatch) -> None:
    """A text tokenised by parts has the tokens of the whole."""
    random.seed(3)
    enc = packing.encoding(packing.load_vocabulary(packing.VOCABULARY))
    t = "".join(random.choice(["word ", " two", "  ", "\n", "12", "é ", "'s", " don't", "..", " a b"]) for _ in range(4000))
    whole = enc.encode_ordinary(t)
    monkeypatch.setattr(packing, "_CHUNK", 50)
    assert packing.tokens_of(enc, t, np.dtype("<u2")).tolist() == whole


# 8

def test_mixing(spark: SparkSession) -> None:
    random.seed(6)
    rows = [(i, " ".join("w" * random.choice([1, 5, 40])), random.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for i in range(900)]
    rows += [(i, "tiny", "z") for i in range(900, 903)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    r = mixing.mix_plan(d).toPandas()
    src = {i: s for i, _, s in rows}
    size = {i: len(blank_words(t)) for i, t, _ in rows}
    order = sorted({s for s in src.values() if s}) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(n for i, n in size.items() if src[i] == s) for s in order}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        for s in over or free:
            target[s] = 3.0 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    taken = Counter()
    for x in r.itertuples():
        s = src[x.doc_id]
        assert x.size == size[x.doc_id] and x.source_size == total[s] and x.target == pytest.approx(target[s], abs=1e-5)
        assert x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[s] += x.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(n for i, n in size.items() if src[i] == s)
    again = mixing.mix_plan(d.repartition(2)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == r.sort_values("doc_id").taken.tolist()
    copies = Counter(x["doc_id"] for x in mixing.mix(d).collect())
    assert copies == {x.doc_id: x.taken // x.size for x in r.itertuples() if x.taken}


def test_mixing_is_fair(spark: SparkSession) -> None:
    """Each document's mean number of copies over many draws is its rate."""
    d = spark.createDataFrame([(i, "w " * (i % 4 + 1), "a" if i < 60 else "b") for i in range(90)], "doc_id long, text string, source string")
    draws = [mixing.mix_plan(d, seed=s).toPandas().sort_values("doc_id") for s in range(12)]
    mean = sum(x.taken / x["size"] for x in draws) / len(draws)
    rate = draws[0].target / draws[0].source_size
    assert abs(mean.mean() - rate.mean()) < 0.05 and abs((mean - rate).abs().mean()) < 0.2


def test_empty_documents_are_drawn(spark: SparkSession) -> None:
    """Documents without words have their source's rate too; they count no words."""
    d = spark.createDataFrame([(i, "w w" if i % 2 else None, "ab"[i % 4 // 2]) for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(d).toPandas()
    copies = Counter(r["doc_id"] for r in mixing.mix(d).collect())
    for s, rows in plan.groupby(plan.doc_id % 4 // 2):
        rate = rows.target.iloc[0] / rows.source_size.iloc[0]
        mine = [copies[i] for i in rows.doc_id if i % 2 == 0]
        assert set(mine) <= {int(rate), int(rate) + 1} and abs(sum(mine) / len(mine) - rate) < 0.15, s
    assert plan.taken[plan.doc_id % 2 == 0].sum() == 0


# 9

def brute_lines(docs: dict, least: int = 5, chars: int = 40) -> dict:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= least and i < max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_line_dedup(spark: SparkSession, batches: int, fanout: int) -> None:
    random.seed(9)
    pool = [c * random.choice([39, 40, 41]) for c in "abcdé😀"] + ["  " + "A" * 40 + "\t", "short", ""]
    docs = {i: "\n".join(random.choices(pool, k=random.randrange(5))) for i in range(40)} | {99: None}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated(d, batches=batches, fanout=fanout).collect()}
    assert got == brute_lines(docs)


def test_lines_of_repeated_ids(spark: SparkSession) -> None:
    """Different texts of one id, null ids among them, count as one document and each lose their own lines."""
    line = [c * 50 for c in "abcd"]
    rows = [(None, f"{line[0]}\nx"), (None, f"y\n{line[0]}\n{line[1]}"), (None, None), (7, line[0]), (7, f"{line[1]}\n{line[0]}"), (8, line[1]), (9, line[0]), (9, line[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.drop_repeated(d, min_docs=3, batches=3).collect())
    assert got == Counter([(None, "x", 1), (None, "y", 2), (None, "", 0), (7, "", 1), (7, "", 2), (8, line[1], 0), (9, line[0], 0), (9, line[0], 0)])


def test_query_goes_through_the_runs(spark: SparkSession, monkeypatch) -> None:
    """Batches come by falling id, each is held against every run that stands, and levels are merged."""
    seen = []
    add = line_dedup.LineRuns.add

    def watched(self, lines):
        standing = [self.spark.table(r).count() for level in self.levels for r in level]
        ids = [r["d"] for r in lines.select("d").distinct().collect()]
        add(self, lines)
        seen.append((min(ids), max(ids), standing, [len(x) for x in self.levels]))

    monkeypatch.setattr(line_dedup.LineRuns, "add", watched)
    d = spark.createDataFrame([(i, f"{'a' * 50}\n{i:050d}") for i in range(60)], "doc_id long, text string")
    got = line_dedup.drop_repeated(d, batches=6).collect()
    assert sum(r["n_dropped"] for r in got) == 59 and all(a > d for (a, _, _, _), (_, d, _, _) in zip(seen, seen[1:], strict=False))
    assert [x[3] for x in seen] == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    assert seen[3][2] == [11, 21] and seen[5][2] == [11, 41]


def test_runs_are_merged_as_they_stand(spark: SparkSession) -> None:
    """Joins and merges of runs neither shuffle nor sort them."""
    store = line_dedup.LineRuns(spark, buckets=4)
    for b in range(2):
        store.levels.append([store._write(spark.createDataFrame([(bytes([i * (b + 1)]), 1, i) for i in range(9)], "h binary, n_docs long, first_doc long").repartition(4, "h"))])
    with line_dedup._sorted_scans(spark):
        merged = store.merged(*store.runs())
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert {(r["h"][0], r["n_docs"], r["first_doc"]) for r in merged.collect()} == {(i, 2 if i % 2 == 0 else 1, i) for i in range(9)} | {(i, 1, i // 2) for i in range(10, 17, 2)}
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quadra_lines")]


def test_line_runs(spark: SparkSession) -> None:
    """A stream of batches: a line stays where it first comes; runs are merged by levels."""
    store = line_dedup.LineRuns(spark, fanout=2, min_chars=3)
    known: set[str] = set()
    for b in range(5):
        lines = {b * 10 + i: f"line{b * i % 4}\nown {b} {i}\nline{i}\nx" for i in range(3)}
        want = {}
        for i, t in lines.items():
            keep = []
            for x in t.split("\n"):
                if len(x) < 3 or x not in known:
                    keep.append(x)
                    known |= {x} if len(x) >= 3 else set()
            want[i] = "\n".join(keep)
        d = spark.createDataFrame(list(lines.items()), "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: r["text"] for r in store.unseen(d).collect()} == want
    assert [len(x) for x in store.levels] == [1, 0, 1]
    h = [r["h"] for r in spark.table(store.levels[2][0]).collect()]
    assert len(h) == len(set(h))
    assert store.counted().count() == len(known)
    store.close()


# 10

def test_warc_index(spark: SparkSession, tmp_path) -> None:
    rows = [(i, f"http://www.{'abc'[i % 3]}.example.com:80/p/{i % 40}?b=2&a=1#x", f"<p>{i // 2}</p>" if i % 7 else None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    places = warc.write_archives(pages, archives).persist()
    root = warc.build_index(places, index, block_lines=10, partitions=3).persist()
    assert sum(r["lines"] for r in root.collect()) == 300
    found = warc.CaptureIndex(root, index, archives)
    assert len(found.root.shards) == 3
    shard = max(f.stat().st_size for f in (tmp_path / "i").iterdir())
    for k in (0, 17, 39):
        url = f"http://A.example.com/p/{k}?a=1&b=2"
        want = {i for i, u, _ in rows if i % 3 == 0 and i % 40 == k}
        got = found.lookup(url)
        assert {r["page_id"] for r in got} == want and found.blocks_read <= 2
        wanted = places.where(places.page_id.isin(*want)).collect()
        assert found.archive_bytes == sum(r["length"] for r in wanted) and found.index_bytes < shard
        byrange = warc.fetch(warc.resolve(spark.createDataFrame([(warc.url_key(url),)], "key string"), root, index), archives).collect()
        assert {r["page_id"] for r in byrange} == want
    assert found.lookup("http://nowhere.org/") == [] and found.archive_bytes == 0
    streamed = warc.read_archives(spark, archives, places).collect()
    resolved = warc.fetch(warc.resolve(warc.capture_keys(pages), root, index), archives).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, resolved))
    back = {r["page_id"]: r for r in resolved}
    assert len(back) == len(resolved) == 300
    for i, _, h in rows:
        payload = (h or "").encode()
        assert (back[i]["payload_bytes"], back[i]["payload_digest"]) == (len(payload), warc.sha1_base32(payload))
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        assert (back[i]["record_type"], back[i]["refers_to"]) == (("response", None) if i == top else ("revisit", top))
        assert back[i]["payload"] == (payload if i == top else None)
    places.unpersist()
    root.unpersist()


def test_warc_hot_capture(spark: SparkSession, tmp_path) -> None:
    """One row very often, keys that need care in a line, null ids: each archived row comes back once, from many shards."""
    rows = [(5, "http://a.com/x", "h")] * 200 + [(i, f"http://b{i % 3}.com/\t\x0b\u2028{i}", str(i)) for i in range(20, 60)] + [(None, "http://a.com/x", "n")] * 3 + [(9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    places = warc.write_archives(pages, f"file://{tmp_path}/a").persist()
    root = warc.build_index(places, f"file://{tmp_path}/i", block_lines=7, partitions=6).persist()
    hot = [r for r in root.collect() if (r["first_key"], r["last_key"]) == ("com,a)/x", "com,a)/x")]
    assert len(hot) >= 2
    got = warc.fetch(warc.resolve(warc.capture_keys(pages), root, f"file://{tmp_path}/i"), f"file://{tmp_path}/a").collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    places.unpersist()
    root.unpersist()


def test_foreign_records(spark: SparkSession, tmp_path) -> None:
    """Archives of another writer: other record types, ids and digests, header case, folding, no payload digest."""
    import gzip

    def record(kind: str, block: bytes, *more: str) -> bytes:
        return gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", f"content-length:{len(block)}", *more]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = "Content-Type: application/http;msgtype=response"
    body = b"HTTP/1.1 200 OK\nX: y\r\n\r\n<p>hi</p>"
    raw = record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a\r\n\tb")
    raw += record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request", "WARC-Target-URI: http://a/")
    raw += record("response", body, http, "WARC-Target-URI: http://a/") + record("response", body, http, "WARC-Payload-Digest: md5:abc")
    raw += record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:1>") + record("resource", b"plain", "Content-Type: text/plain")
    (tmp_path / "x.warc.gz").write_bytes(raw)
    got = warc.read_archives(spark, f"file://{tmp_path}", spark.createDataFrame([("x.warc.gz",)], "file string")).collect()
    assert [(r["record_type"], r["payload"], r["payload_bytes"], r["page_id"], r["refers_to"]) for r in got] == [
        ("warcinfo", b"software: x\r\n", 13, None, None), ("request", b"", 0, None, None), ("response", b"<p>hi</p>", 9, None, None),
        ("response", b"<p>hi</p>", 9, None, None), ("revisit", None, None, None, None), ("resource", b"plain", 5, None, None)]
    assert got[2]["payload_digest"] == warc.sha1_base32(b"<p>hi</p>") and got[3]["payload_digest"] == "md5:abc" and got[2]["url"] == "http://a/"
    for bad in (b"junk", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.0\r\nContent-Length: 1\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\n\r\nx"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# pipeline

def test_pipeline_stages(spark: SparkSession, tmp_path) -> None:
    """Every stage against loops over its own input: what it keeps, in the columns that came, nothing else."""
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = d.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in d.collect()]
        text = {r[0]: r[1] for r in before}
        out = stage(spark, d, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(r) for r in out.collect()]
        if i < 4:
            assert out.columns == columns and set(after) <= set(before)
        ids = Counter(r[0] for r in after)
        if name == "quality_classifier":
            space = quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))
            for k, t in text.items():
                x = quality._vectors(*utf8(pa.array([t])))
                assert (k in ids) == (space.score(x, 16, 8.0, np.array([k]))[0] >= 0.3)
        elif name == "minhash_near_dedup":
            assert ids == Counter(k for k, (_, root) in brute_components(text, 5, 80).items() if root == k)
        elif name == "benchmark_decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            assert ids == Counter(k for k, x in brute_contamination(text, items).items() if not x[4])
        elif name == "source_mixing":
            size = {k: len(blank_words(t)) for k, t in text.items()}
            source = {r[0]: r[columns.index("source")] for r in before}
            taken, total = Counter(), Counter()
            for k, n in size.items():
                total[source[k]] += n
                taken[source[k]] += ids[k] * n
            target = {r["source"]: r["target"] for r in mixing.source_targets(d.select("source", mixing.word_count(d.text).alias("size"))).collect()}
            assert all(abs(taken[s] - target[s]) <= max(n for k, n in size.items() if source[k] == s) for s in total) and max(ids.values()) <= 3
        else:
            enc = packing.encoding(packing.load_vocabulary(packing.VOCABULARY))
            parts = defaultdict(list)
            for r in out.collect():
                tokens = np.frombuffer(r["ids"], "<u2")
                for k, x in enumerate(zip(r["doc_ids"], r["doc_rows"], r["starts"], strict=True)):
                    parts[x[:2]].append((x[2], tokens[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]))
            back = Counter((k, enc.decode(np.concatenate([p for _, p in sorted(x, key=lambda y: y[0])]).tolist())) for (k, _), x in parts.items())
            assert back == Counter((r[0], r[1]) for r in before)
        kept[name] = sum(ids.values())
        d = out
    assert kept["benchmark_decontamination"] < kept["minhash_near_dedup"] < kept["quality_classifier"] < 200
