"""Search queries: vectors, places, full text, phonetic codes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.functions import geo, phonetic
from quadra.operators.graph import cut
from quadra.operators.hnsw import LayeredIndex
from quadra.operators.search import IvfIndex, StoredTextIndex, analyze, nearest, top_vectors
from quadra.sources.shared import shared_dir
from quadra.sources.tables import table

REGISTERED: dict = {}


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


for _name, _metric, _sql in (("vec_l2_topk", "l2", "list_distance(e.embedding::DOUBLE[], q.v)"), ("vec_cosine_topk", "cosine", "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.v)"), ("vec_ip_topk", "inner_product", "-list_inner_product(e.embedding::DOUBLE[], q.v)")):
    REGISTERED[_name] = (lambda spark, d, m=_metric: top_vectors(table(spark, d, "embeddings"), "embedding", "vec_id", _query_vector(spark, d), 10, m, 4),
                         f"SELECT vec_id, round({_sql}, 4) AS distance FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) q ORDER BY distance, vec_id LIMIT 10")


def _recall(exact: DataFrame, index: IvfIndex, queries: DataFrame, probes: int, k: int, rerank: int = 4) -> DataFrame:
    """One row, the mean recall over ``queries`` of an inverted-list search against the exact ``k`` nearest."""
    found = index.search_all(queries, k, probes, rerank)
    hits = exact.join(found, ["query", index.key], "left").groupBy("query").agg((F.count(found["distance"]) / F.count(F.lit(1))).alias("recall"))
    return hits.agg(F.avg("recall").alias("recall"))


def vec_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether probing seven of eight lists finds nine tenths of the exact ten nearest on average, plain and with vectors
    quantized to 8, 4, 2 and 1 bits; the fewer bits, the more rows are ranked again.

    Every vector whose id is divisible by 100 is a query.
    """
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    kinds = (("ivf", None, 4), ("ivf_q8", 8, 4), ("ivf_q4", 4, 4), ("ivf_q2", 2, 64), ("ivf_q1", 1, 48))
    # found once for all kinds, as are the centres
    exact = cut(nearest(e, q, "embedding", "vec_id", 10))
    out = model = None
    for name, bits, rerank in kinds:
        index = IvfIndex(e, "embedding", "vec_id", 8, bits=bits, model=model)
        model = index.model
        x = _recall(exact, index, q, 7, 10, rerank).select(F.lit(name).alias("kind"), (F.col("recall") >= 0.9).alias("good"))
        out = x if out is None else out.unionByName(x)
    return out


def vec_ivf_all_lists(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, through an index of which every list is probed."""
    e = table(spark, d, "embeddings")
    return IvfIndex(e, "embedding", "vec_id", 8).search_all(e.where("vec_id % 100 = 0"), 10, 8, digits=4)


REGISTERED["vec_ivf_all_lists"] = (vec_ivf_all_lists, """SELECT query, vec_id, distance FROM (
  SELECT q.vec_id AS query, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4), e.vec_id) AS n
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE n <= 10""")
REGISTERED["vec_ivf_recall"] = (vec_ivf_recall, "SELECT * FROM (VALUES ('ivf', true), ('ivf_q8', true), ('ivf_q4', true), ('ivf_q2', true), ('ivf_q1', true)) t(kind, good)")

def vec_layered_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether graphs in layers find nine tenths of the exact ten nearest on average, over all vectors and for every one whose
    id is divisible by 100."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    found = LayeredIndex.build(e, "embedding", "vec_id", f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}").search_all(q, 10)
    exact = nearest(e, q, "embedding", "vec_id", 10)
    hits = exact.join(found, ["query", "vec_id"], "left").groupBy("query").agg((F.count(found["distance"]) / F.count(F.lit(1))).alias("recall"))
    return hits.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("good"))


REGISTERED["vec_layered_recall"] = (vec_layered_recall, "SELECT count(*) AS queries, true AS good FROM embeddings WHERE vec_id % 100 = 0")

_PLACES = "SELECT c_custkey AS id, (c_custkey * 37) % 180 - 90 + 0.25 AS lat, (c_custkey * 91) % 360 - 180 + 0.5 AS lon FROM customer"


def _places(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), ((c * 37) % 180 - 90 + 0.25).alias("lat"), ((c * 91) % 360 - 180 + 0.5).alias("lon"))


_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians({y}::DOUBLE)) / 2), 2) + cos(radians(lat)) * cos(radians({y}::DOUBLE)) * pow(sin(radians(lon - {x}) / 2), 2))))"
REGISTERED["geo_radius"] = (lambda spark, d: _places(spark, d).where(geo.within_radius(F.col("lat"), F.col("lon"), 10.0, 20.0, 2_000_000)).select("id"),
                            f"SELECT id FROM ({_PLACES}) WHERE {_HAVERSINE.format(y='10', x='20')} <= 2000000")
REGISTERED["geo_bbox_antimeridian"] = (lambda spark, d: _places(spark, d).where(geo.within_bbox(F.col("lat"), F.col("lon"), -20, 170, 30, -160)).select("id"),
                                       f"SELECT id FROM ({_PLACES}) WHERE lat BETWEEN -20 AND 30 AND (lon >= 170 OR lon <= -160)")
REGISTERED["geo_polygon"] = (lambda spark, d: _places(spark, d).where(geo.within_polygon(F.col("lat"), F.col("lon"), [(0, 0), (0, 60), (60, 0)])).select("id"),
                             f"SELECT id FROM ({_PLACES}) WHERE lat >= 0 AND lon >= 0 AND lat + lon <= 60")
REGISTERED["geo_knn"] = (lambda spark, d: geo.nearest(_places(spark, d), "lat", "lon", "id", 5.0, 5.0, 12).select("id", F.round("distance", 1).alias("metres")),
                         f"SELECT id, round({_HAVERSINE.format(y='5', x='5')}, 1) AS metres FROM ({_PLACES}) ORDER BY {_HAVERSINE.format(y='5', x='5')}, id LIMIT 12")
REGISTERED["geo_cells"] = (lambda spark, d: _places(spark, d).groupBy(geo.cell(F.col("lat"), F.col("lon"), 3).alias("cell")).agg(F.count("*").alias("n")),
                           "SELECT " + " + ".join(f"((x >> {b}) % 2 << {2 * b}) + ((y >> {b}) % 2 << {2 * b + 1})" for b in range(3)) + f" AS cell, count(*) AS n FROM (SELECT CAST(floor((lat + 90) / 180 * 8) AS BIGINT) AS y, CAST(floor((lon + 180) / 360 * 8) AS BIGINT) AS x FROM ({_PLACES})) GROUP BY 1")

_STOP_SQL = "('" + "','".join("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()) + "')"
_POST = f"""tok AS (SELECT doc_id AS doc, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
kept AS (SELECT * FROM tok WHERE term <> '' AND term NOT IN {_STOP_SQL}),
lens AS (SELECT doc_id AS doc, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT doc, count(*) AS n FROM kept GROUP BY doc) k ON k.doc = doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT kept.doc, term, count(*) AS tf, any_value(dl) AS dl FROM kept JOIN lens ON lens.doc = kept.doc GROUP BY kept.doc, term),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT doc, post.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM post JOIN freq ON freq.term = post.term, st)"""


_BUILT: dict[tuple, str] = {}


def text_index(spark: SparkSession, d: str) -> StoredTextIndex:
    """The stored index of a folder's documents: built by its first search, in the shared folder, for files as they are."""
    docs = table(spark, d, "documents")
    jvm = spark.sparkContext._jvm
    stamps = []
    for f in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, *stamps)
    if key not in _BUILT:
        folder = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
        StoredTextIndex.build(docs, "doc_id", "text", folder)
        _BUILT[key] = folder
    return StoredTextIndex(spark, _BUILT[key])


def _fts(name: str, query: str, oracle: str, k: int | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        index = text_index(spark, d)
        found = index.top(query, k) if k else index.match(query)
        return found.select("doc", F.round("score", 6).alias("score"))

    REGISTERED[name] = (run, f"WITH {_POST} SELECT doc, round(score, 6) AS score FROM ({oracle})")


_term = lambda *ts: f"SELECT doc, sum(s) AS score FROM bm WHERE term IN ({', '.join(repr(t) for t in ts)}) GROUP BY doc"
_fts("fts_term", "thing", _term("thing"))
_fts("fts_and", "erst AND sting", f"SELECT a.doc, a.score + b.score AS score FROM ({_term('erst')}) a JOIN ({_term('sting')}) b ON a.doc = b.doc")
_fts("fts_or", "erst OR sting", f"SELECT doc, max(score) AS score FROM ({_term('erst')} UNION ALL {_term('sting')}) GROUP BY doc")
_fts("fts_not", "erst NOT sting", f"SELECT * FROM ({_term('erst')}) WHERE doc NOT IN (SELECT doc FROM bm WHERE term = 'sting')")
_fts("fts_not_only", "NOT erst", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc FROM bm WHERE term = 'erst')")
_fts("fts_prefix", "thing*", "SELECT doc, sum(s) AS score FROM bm WHERE starts_with(term, 'thing') GROUP BY doc")
_fts("fts_phrase", '"erst thing"', "SELECT doc, sum(s) AS score FROM bm WHERE term IN ('erst', 'thing') GROUP BY doc HAVING count(*) = 2")
_fts("fts_topk", "erst thing", f"SELECT * FROM (SELECT a.doc, a.score + b.score AS score FROM ({_term('erst')}) a JOIN ({_term('thing')}) b ON a.doc = b.doc) ORDER BY score DESC, doc LIMIT 10", 10)
REGISTERED["fts_analyzers"] = (lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(analyze(F.col("text"), "standard")).cast("long").alias("standard"), F.size(analyze(F.col("text"), "simple")).cast("long").alias("simple")),
                               f"WITH {_POST} SELECT doc_id, (SELECT dl FROM lens WHERE doc = doc_id) AS standard, (SELECT count(*) FROM tok WHERE doc = doc_id AND term <> '') AS simple FROM documents")


#: Codes of the words of the tables, worked out by hand: word, Soundex, Metaphone, Double Metaphone, Caverphone.
_SOUNDS = """
africa A162 AFRK AFRK AFRKA11111
america A562 AMRK AMRK AMRKA11111
anvil A514 ANFL ANFL ANFA111111
asia A200 AX AS ASA1111111
automobile A351 ATMB ATMP ATMPA11111
blue B400 BL PL PLA1111111
bolt B430 BLT PLT PT11111111
building B435 BLTN PLTN PTNK111111
click C420 KLK KLK KLK1111111
cold C430 KLT KLT KT11111111
east E230 EST AST AST1111111
economy E255 EKNM AKNM AKNMA11111
error E660 ERR ARR ARA1111111
europe E610 ERP ARP ARP1111111
furniture F653 FRNT FRNT FNTA111111
gear G600 JR JR KA11111111
gizmo G250 JSM JSM KSMA111111
hot H300 HT HT AT11111111
household H243 HSHL HSHL AST1111111
large L620 LRJ LRJ LK11111111
machinery M256 MXNR MXNR MKNRA11111
medium M350 MTM MTM MTM1111111
middle M340 MTL MTL MTA1111111
new N000 N N NA11111111
old O430 OLT ALT AT11111111
plate P430 PLT PLT PLT1111111
promo P650 PRM PRM PRMA111111
purchase P622 PRXS PRXS PKS1111111
red R300 RT RT RT11111111
ring R520 RNK RNK RNK1111111
rod R300 RT RT RT11111111
signup S251 SKNP SNP SKNP111111
small S540 SML SML SMA1111111
standard S353 STNT STNT STNTT11111
view V000 F F FA11111111
widget W323 WJT AJT WKT1111111
"""
_NAMES = {"part": ["p_name", "p_type"], "customer": ["c_mktsegment"], "events": ["event_type"], "region": ["r_name"]}
_KNOWN = ", ".join("(" + ", ".join(f"'{x}'" for x in line.split()) + ")" for line in _SOUNDS.split("\n") if line)
_WORDS = " UNION ".join(f"SELECT unnest(string_split(lower({c}), ' ')) AS word FROM {t}" for t, cs in _NAMES.items() for c in cs)


def phonetic_codes(spark: SparkSession, d: str) -> DataFrame:
    """Four codes of every word in the names of five columns."""
    words = None
    for t, columns in _NAMES.items():
        for c in columns:
            w = table(spark, d, t).select(F.explode(F.split(F.lower(c), " ")).alias("word")).distinct()
            words = w if words is None else words.union(w)
    w = F.col("word")
    return words.distinct().select(w, phonetic.soundex(w).alias("soundex"), phonetic.metaphone(w).alias("metaphone"), phonetic.double_metaphone_udf(w).alias("double_metaphone"), phonetic.caverphone(w).alias("caverphone"))


REGISTERED["phonetic_codes"] = (phonetic_codes, f"SELECT word, soundex, metaphone, double_metaphone, caverphone FROM ({_WORDS}) LEFT JOIN (VALUES {_KNOWN}) AS k(word, soundex, metaphone, double_metaphone, caverphone) USING (word)")


def geo_cover(spark: SparkSession, d: str) -> DataFrame:
    """A box by the ranges of cells that cover it, then exactly."""
    lat, lon = F.col("lat"), F.col("lon")
    ranges = geo.cover(-20, 170, 30, -160, 6)
    return _places(spark, d).where(geo.in_ranges(geo.cell(lat, lon, 6), ranges) & geo.within_bbox(lat, lon, -20, 170, 30, -160)).select("id")


REGISTERED["geo_cover"] = (geo_cover, REGISTERED["geo_bbox_antimeridian"][1])


def geo_stored(spark: SparkSession, d: str) -> DataFrame:
    """The places of a box across the antimeridian and of a circle, from places stored by cell."""
    stored = geo.StoredPlaces.build(_places(spark, d), "lat", "lon", f"{shared_dir(spark)}/places-{uuid.uuid4().hex}", 8)
    box, circle = stored.within_bbox(-20, 170, 30, -160), stored.within_radius(10.0, 20.0, 2_000_000)
    return box.select(F.lit("box").alias("search"), "id").unionByName(circle.select(F.lit("circle").alias("search"), "id"))


REGISTERED["geo_stored"] = (geo_stored, f"SELECT 'box' AS search, id FROM ({REGISTERED['geo_bbox_antimeridian'][1]}) UNION ALL SELECT 'circle', id FROM ({REGISTERED['geo_radius'][1]})")


def geo_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Places in a polygon, and places that are a point."""
    p, at = _places(spark, d), (F.col("lat"), F.col("lon"))
    inside = p.where(geo.st_intersects(("polygon", [(0, 0), (0, 60), (60, 0)]), None, *at)).select(F.lit("in").alias("kind"), "id")
    return inside.unionByName(p.where(geo.st_contains(("point", (-52.75, 91.5)), *at)).select(F.lit("at").alias("kind"), "id"))


REGISTERED["geo_shapes"] = (geo_shapes, f"SELECT 'in' AS kind, id FROM ({_PLACES}) WHERE lat >= 0 AND lon >= 0 AND lat + lon <= 60 UNION ALL SELECT 'at', id FROM ({_PLACES}) WHERE lat = -52.75 AND lon = 91.5")
