"""Operator 3, n-gram Jaccard join with Bayesian candidate pruning.

1. Equal texts are one class. Every class gets the hashes of its five-word shingles and a MinHash signature.
2. Classes that agree in a band of the signature share a bucket. Pairs from small buckets are pruned by comparing
   their signatures step by step: a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls below the tolerance. A large bucket only links its members to its first one.
3. What remains is grouped into clusters. Inside a cluster, blocks of classes meet in one task each: the same
   pruning again, then the exact similarity of all pairs that are left. Only counts of links and one
   link per member leave the task, never all pairs of a group.
4. Components of the verified links are the groups of near duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.graph import components
from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import text_of
from corpuslake.session import cut_lineage

WORDS = 5
#: Threshold as a fraction of whole numbers, so that it is compared exactly.
SIMILAR = (4, 5)
#: 40 bands of 5 hashes: a pair at the threshold shares no band with probability 1.2e-7.
BANDS, BAND = 40, 5
HASHES = BANDS * BAND
#: Hashes compared before each decision, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 40, 1e-8
#: Buckets up to this size give pairs; larger ones are covered by blocks. No bucket is cut.
PAIRED = 32
BLOCK = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BASE, _C1, _C2 = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `words` words; a shorter text is one run, no word gives none.

    Words are runs of characters other than ASCII white space.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])])
        hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        run = min(words, len(hashes))
        total = np.zeros(len(hashes) - run + 1, dtype=np.uint64)
        for i in range(run):
            total = total * np.uint64(_BASE) + hashes[i:len(hashes) - run + 1 + i]
        return np.unique(_mix(total))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    low = np.full(HASHES, (1 << 64) - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 512):  # a long text is taken in slices
            low = np.minimum(low, (grams[at:at + 512, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(BANDS, BAND)
    total = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BAND):
            total = _mix(total * np.uint64(_BASE) + parts[:, i])
    return total.view(np.int64)


def least_matches(compared: int, tolerance: float = TOLERANCE, similar: tuple[int, int] = SIMILAR) -> int:
    """Fewest matches among `compared` hashes with which the posterior P(similarity >= threshold) stays above `tolerance`.

    With a uniform prior the posterior is a Beta distribution, whose tail is a binomial sum. Signatures keep 8 bits
    of each hash, so unequal hashes may look equal: that can only keep a pair, never drop it.
    """
    t = similar[0] / similar[1]
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * t ** m * (1 - t) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices are still candidates after all steps; each step looks at what is left only."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for upto in range(STEP, HASHES + 1, STEP):
        matches[alive] += (a[alive, upto - STEP:upto] == b[alive, upto - STEP:upto]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least_matches(upto)]
    return alive


def similar_enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    return similar[1] * both >= similar[0] * (a + b - both)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, as a matrix product over the shingles
    that occur on both sides, in slices of columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, len(shared), 8_192):
        columns = shared[at:at + 8_192]
        sides = []
        for values, rows, n in ((a, row_a, len(left)), (b, row_b, len(right))):
            place = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            hit = columns[place] == values
            side = np.zeros((n, len(columns)), dtype=np.float32)
            side[rows[hit], place[hit]] = 1
            sides.append(side)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def linked(sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], same: bool) -> np.ndarray:
    """Index pairs (i, j) whose exact similarity reaches the threshold; i < j only if both sides are the same block."""
    i, j = np.triu_indices(len(sig_a), 1) if same else (x.ravel() for x in np.indices((len(sig_a), len(sig_b))))
    keep = survivors_of(sig_a, sig_b, i, j)
    i, j = i[keep], j[keep]
    if not len(i):
        return np.zeros((0, 2), dtype=int)
    rows, i_at = np.unique(i, return_inverse=True)
    columns, j_at = np.unique(j, return_inverse=True)
    both = common([sets_a[r] for r in rows], [sets_b[c] for c in columns])[i_at, j_at]
    size_a, size_b = np.array([len(sets_a[r]) for r in rows]), np.array([len(sets_b[c]) for c in columns])
    good = similar_enough(both, size_a[i_at], size_b[j_at])
    return np.stack([i[good], j[good]], axis=1)


def survivors_of(sig_a: np.ndarray, sig_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`survivors` over index pairs, in slices that bound the memory."""
    return np.concatenate([at + survivors(sig_a[i[at:at + 8_192]], sig_b[j[at:at + 8_192]])
                           for at in range(0, len(i), 8_192)] or [np.zeros(0, dtype=int)])


def stars(names: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """(name, smallest name of its group) for all linked items but the smallest ones; `pairs` are places in `names`."""
    parent = list(range(len(names)))
    for x, y in pairs.tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if names[x] < names[y]:
            parent[y] = x
        else:
            parent[x] = y
    out = []
    for i in range(len(names)):
        root = i
        while parent[root] != root:
            root = parent[root]
        if root != i:
            out.append((names[i], names[root]))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, sigs, bands = [], [], []
            for text in part.column("text"):
                grams = shingles(text.as_py())
                sig = signature(grams)
                counts.append(len(grams))
                sigs.append((sig & np.uint32(0xFF)).astype(np.uint8).tobytes())
                bands.append(band_hashes(sig) if len(grams) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n", "sig", "bands"])


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).take(pa.array(survivors(a, b)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by meeting (cluster, i, j); a meeting is held until it is complete. The size of a side is
    about `BLOCK` classes, whatever the size of the cluster."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def meet(rows: list[dict]) -> pa.RecordBatch:
        i, j = rows[0]["i"], rows[0]["j"]
        sides = [[r for r in rows if r["block"] == x] for x in ((i,) if i == j else (i, j))]
        sig = [np.frombuffer(b"".join(r["sig"] for r in side), dtype=np.uint8).reshape(-1, HASHES) for side in sides]
        sets = [[np.frombuffer(r["grams"], dtype=np.uint64) for r in side] for side in sides]
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        if all(sides):
            pairs = linked(sig[0], sig[-1], sets[0], sets[-1], i == j)
            offset = 0 if i == j else len(sides[0])
            every = sides[0] + (sides[1] if i != j else [])
            copies = np.array([r["copies"] for r in every])
            ends = pairs + np.array([0, offset])
            counts = np.zeros(len(every), dtype=np.int64)
            np.add.at(counts, ends[:, 0], copies[ends[:, 1]])
            np.add.at(counts, ends[:, 1], copies[ends[:, 0]])
            for x in np.flatnonzero(counts):
                out["a"].append(every[x]["tid"])
                out["b"].append(every[x]["tid"])
                out["links"].append(int(counts[x]))
            for a, b in stars([r["tid"] for r in every], ends):
                out["a"].append(a)
                out["b"].append(b)
                out["links"].append(0)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    waiting: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for r in batch.slice(at, 256).to_pylist():
                if waiting and any(r[c] != waiting[0][c] for c in ("cluster", "i", "j")):
                    yield meet(waiting)
                    waiting = []
                waiting.append(r)
    if waiting:
        yield meet(waiting)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            grams = [shingles(t.as_py()).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("tid", "copies", "sig", "cluster", "size")] + [pa.array(grams, pa.binary())],
                                             ["tid", "copies", "sig", "cluster", "size", "grams"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: `doc_id`, `text_key` (MD5 of the text), `class_id`, `n_links`, and whether it `stays` if
    one document of each group is kept.

    Two documents are linked if their texts are equal or the Jaccard similarity of their five-word shingles is at
    least 0.8. `class_id` is the smallest key that can be reached over links (null keys do not count), `n_links` the
    number of other documents that a document is linked with, copies included. A null text counts as empty; texts
    without a word are linked with their equals only; repeated rows are copies of one another; an empty table gives
    no row. Other columns are not read.

    Candidates are found by probability: a pair at the threshold is missed with probability 1.2e-7 by the bands and
    about 1e-8 by the pruning; more similar ones with less. Every link reported is exact.
    """
    spark = df.sparkSession
    documents = df.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    documents = documents.withColumn("key", F.md5(F.encode("text", "UTF-8")))
    signed = documents.mapInArrow(_signed, "doc_id bigint, key string, n bigint, sig binary, bands array<bigint>")
    classes = signed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
                                        F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.withColumn("tid", F.monotonically_increasing_id()), "join-classes")

    members = classes.where(F.col("n") > 0).select("tid", F.explode("bands").alias("h"))
    buckets = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("tid").alias("first")).where(F.col("size") > 1)
    buckets = cut_lineage(buckets.withColumnRenamed("h", "bucket"), "join-buckets")  # so that a skewed join can be split
    members = members.join(buckets, F.col("h") == F.col("bucket")).select("h", "size", "first", "tid")
    members = cut_lineage(members, "join-members")
    few = members.where(F.col("size") <= PAIRED).select("h", "tid")
    pairs = few.select("h", F.col("tid").alias("a")).join(few.select("h", F.col("tid").alias("b")), "h").where(F.col("a") < F.col("b"))
    pairs = pairs.select("a", "b").distinct()
    sigs = classes.select("tid", "sig")
    pairs = pairs.join(sigs.select(F.col("tid").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = pairs.join(sigs.select(F.col("tid").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = pairs.mapInArrow(_pruned, "a bigint, b bigint")
    stars = members.where(F.col("size") > PAIRED).select(F.col("first").alias("a"), F.col("tid").alias("b"))
    clusters = components(pairs.unionAll(stars))
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    clusters = clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), "size")

    wanted = classes.join(clusters, F.col("tid") == F.col("node")).select("key", "first_id", "tid", "copies", "sig", "cluster", "size")
    wanted = cut_lineage(wanted, "join-wanted")
    # one copy of each text; the document id in the join key spreads the copies of a text
    texts = documents.join(wanted.withColumnsRenamed({"key": "k", "first_id": "f"}),
                           (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("f")))
    texts = texts.select("tid", "copies", "sig", "cluster", "size", "text").dropDuplicates(["tid"])
    sets = texts.mapInArrow(_grams, "tid bigint, copies bigint, sig binary, cluster bigint, size bigint, grams binary")
    sets = cut_lineage(sets, "join-sets")

    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("bigint")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("tid"), blocks))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    placed = placed.select("cluster", "i", "j", "block", "tid", "copies", "sig", "grams")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = placed.repartition(tasks, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "tid")
    links = cut_lineage(met.mapInArrow(_blocks, "a bigint, b bigint, links bigint"), "join-links")

    counted = links.where(F.col("a") == F.col("b")).groupBy(F.col("a").alias("t")).agg(F.sum("links").alias("links"))
    grouped = components(links.where(F.col("a") != F.col("b")).select("a", "b"))
    rooted = classes.select("tid", "key", "copies", "first_id").join(grouped, F.col("tid") == F.col("node"), "left")
    rooted = rooted.join(counted, F.col("tid") == F.col("t"), "left")
    rooted = rooted.select("key", "first_id", F.coalesce("root", "tid").alias("root"),
                           (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rooted = cut_lineage(rooted, "join-roots")
    first = F.min(F.struct(F.col("first_id").isNull().alias("unknown"), "first_id", "key")).alias("first")
    names = rooted.groupBy("root").agg(first).select("root", F.col("first.first_id").alias("class_id"), F.col("first.key").alias("class_key"))
    named = rooted.join(names, "root").select(F.col("key").alias("of"), "first_id", "class_id", "class_key", "n_links")
    named = cut_lineage(named, "join-names")
    found = documents.select("doc_id", "key").join(named, F.col("key") == F.col("of"))
    stays = (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return found.select("doc_id", F.col("key").alias("text_key"), "class_id", "n_links", stays.alias("stays"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df`, of each group of near duplicates the one with the smallest key (of repeated rows one)."""
    stays = near_duplicates(df, key, text).where("stays")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    stays = stays.select(name.alias("near_name"), F.col("text_key").alias("near_key")).distinct()
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    named = df.select(row, F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("near_name"),
                      F.md5(F.encode(text_of(text), "UTF-8")).alias("near_key"))
    kept = named.join(stays, ["near_name", "near_key"], "left_semi").dropDuplicates(["near_name", "near_key"])  # partitioned alike
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
classes AS (SELECT text, any_value(w) AS w, min(doc_id) AS first_id, count(*) AS copies FROM words GROUP BY text),
grams AS (
  SELECT DISTINCT first_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM classes),
sizes AS (SELECT first_id, count(*) AS n FROM grams GROUP BY first_id),
common AS (SELECT a.first_id AS x, b.first_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.first_id < b.first_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes s ON x = s.first_id JOIN sizes t ON y = t.first_id WHERE 5 * c >= 4 * (s.n + t.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT first_id AS x, first_id AS y FROM classes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
named AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
counted AS (SELECT x, sum(copies) AS links FROM both_ways JOIN classes ON y = first_id GROUP BY x)
SELECT doc_id, class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links
FROM words JOIN classes USING (text) JOIN named ON first_id = named.x LEFT JOIN counted ON first_id = counted.x
"""


@query("op3_bayesian_jaccard_join", JACCARD_SQL)
def op3_bayesian_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links")
