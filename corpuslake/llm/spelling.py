"""Operator 12, spelling variants by a relational trie frontier.

The trie is a table of edges (node, next letter); a node is the prefix that leads to it. The frontier holds states
(word, position, node, edits). At every level it is joined with the edges of that depth: a state without an edit
walks its own word and sends out states with one substituted, inserted or deleted letter, a state with an edit must
follow its word exactly. A state that ends in a word has found a neighbour.

An edit lies in the second half of a word or in the second half of the reversed word. So both tries are walked, and
words enter them in the middle, where nodes have few branches. An edge also names the letters that may follow it, so
a state that would die at the next level is never made.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.session import cut_lineage, shared_dir

SHORTEST, LEAST, RATIO, TYPO = 6, 5, 5, 199
#: Words of up to so many letters walk the trie, one job a level. Longer ones meet by their variants with a letter less.
LONGEST = 40
#: Words that a task counts before it hands its counts on. Bounds memory, not results.
COUNTED = 200_000


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, typo: int | None = None) -> DataFrame:
    """`word, n`: runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of at least `shortest` letters in all texts, A-Z in lower case.

    With `typo`, a run whose CRC-32 of `<key>:<run>` is divisible by it loses one letter, at that number modulo its
    length. A null text has no runs; a null key reads `null`. Tasks add up before the shuffle.
    """
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        find = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest).findall
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                # one byte a letter: a character beyond U+00FF is no letter here and becomes a question mark
                runs = find(value.as_py().encode("latin-1", "replace").lower())
                if typo is None:
                    counts.update(runs)
                else:
                    start = zlib.crc32(f"{name.as_py()}:".encode())
                    for word, n in Counter(runs).items():
                        number = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if number % typo == 0:
                            at = number % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield made()
        if counts:
            yield made()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _edges(paths: DataFrame) -> DataFrame:
    """Edges of both tries: side, depth, node, letter, the letters that may follow, and whether a word ends there.

    The edge without a letter says that the node itself is a word. Nodes above the middle of every word below them
    are never visited and left out.
    """
    half = F.floor((F.length("path") - 1) / 2).cast("int")
    steps = paths.select("side", "path", F.explode(F.sequence(half, F.length("path"))).alias("depth"))
    steps = steps.select("side", "depth", F.expr("substring(path, 1, depth)").alias("node"), F.expr("substring(path, depth + 1, 1)").alias("letter"),
                         F.expr("substring(path, depth + 2, 1)").alias("next"), (F.length("path") == F.col("depth") + 1).alias("ends"))
    return steps.groupBy("side", "depth", "node", "letter").agg(
        F.array_join(F.collect_set("next"), "").alias("after"), F.max("ends").alias("ends"))  # at most one entry a letter


def _letter(position: str) -> str:
    return f"substring(path, {position} + 1, 1)"


def _moved(position: str, child: str = "concat(s.node, e.letter)") -> str:
    """A state after an edit at the node `child`, kept if its word can go on or ends in a word there."""
    following = _letter(position).replace("path", "s.path")
    done = f"{position} = length(s.path)"
    return (f"named_struct('position', {position}, 'node', {child}, 'found', {done}, "
            f"'alive', CASE WHEN {done} THEN e.ends ELSE instr(e.after, {following}) > 0 END)")


def _level(spark: SparkSession, whole: DataFrame, edited: DataFrame | None, edges: DataFrame, depth: int) -> DataFrame:
    """States of the next depth, and neighbours found on the way (`found`)."""
    # without an edit: substitution, insertion, deletion before a match; the edge without a letter: deletion of the last letter
    own = _letter("s.position").replace("path", "s.path")
    later = _letter("s.position + 1").replace("path", "s.path")
    spawned = whole.alias("s").join(edges.alias("e"), F.expr("s.side = e.side AND s.node = e.node"))
    spawned = spawned.selectExpr("s.side", "s.path", f"""filter(array(
        CASE WHEN e.letter <> '' AND s.position < length(s.path) AND e.letter <> {own} THEN {_moved("s.position + 1")} END,
        CASE WHEN e.letter <> '' THEN {_moved("s.position")} END,
        CASE WHEN e.letter <> '' AND s.position + 1 < length(s.path) AND e.letter = {later} THEN {_moved("s.position + 2")} END,
        CASE WHEN e.letter = '' AND s.position + 1 = length(s.path)
             THEN named_struct('position', s.position + 1, 'node', s.node, 'found', true, 'alive', true) END), x -> x.alive) AS made""")
    states = spawned.where("size(made) > 0").select("side", "path", F.explode("made").alias("x"))
    if edited is not None:
        walked = edited.alias("s").join(edges.alias("e"), F.expr(f"s.side = e.side AND s.node = e.node AND e.letter = {own}"))
        walked = walked.selectExpr("s.side", "s.path", f"{_moved('s.position + 1')} AS x").where("x.alive")
        states = states.unionByName(walked)
    return states.select("side", "path", "x.position", "x.node", "x.found")


def trie_neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """`word, near` for all words of at most `longest` letters that differ by one letter inserted, deleted or replaced."""
    spark = words.sparkSession
    words = words.where(F.length("word") <= longest)
    paths = words.select(F.lit("f").alias("side"), F.col("word").alias("path")).unionByName(
        words.select(F.lit("r").alias("side"), F.reverse("word").alias("path")))
    paths = cut_lineage(paths, "spelling-paths")
    low, top = paths.agg(F.min(F.length("path")), F.max(F.length("path"))).first()
    if top is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    at = shared_dir(spark, "spelling-edges")
    _edges(paths).write.partitionBy("depth").parquet(at)
    edges = spark.read.parquet(at)
    frontier = shared_dir(spark, "spelling-frontier")
    edited, states = None, "side string, path string, position int, node string, found boolean"
    for depth in range(low // 2, top + 1):
        inside = (F.floor(F.length("path") / 2) <= depth) & (F.length("path") >= depth)
        whole = paths.where(inside).select("side", "path", F.lit(depth).alias("position"), F.substring("path", 1, depth).alias("node"))
        _level(spark, whole, edited, edges.where(F.col("depth") == depth), depth).write.parquet(f"{frontier}/level={depth}")
        edited = spark.read.schema(states).parquet(f"{frontier}/level={depth}").where(~F.col("found"))
    found = spark.read.schema(states).parquet(*[f"{frontier}/level={depth}" for depth in range(low // 2, top + 1)]).where("found")
    turned = [F.when(F.col("side") == "r", F.reverse(c)).otherwise(F.col(c)) for c in ("path", "node")]
    return found.select(turned[0].alias("word"), turned[1].alias("near")).distinct()


#: Two hashes of the variants of long words: modulus and base.
PRIMES = (((1 << 61) - 1, 1_000_003), ((1 << 59) - 55, 998_244_353))


def long_neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """`word, near` for pairs in which a word has more than `longest` letters.

    Words differ in one letter exactly if they agree without the letter at one position, and by an inserted letter exactly
    if one of them without a letter is the other. Variants are compared by 120 bits of polynomial hashes. At most
    as many words share a variant and its position as there are letters, so no group is large.
    """
    words = words.where(F.length("word") >= longest).select(F.md5("word").alias("id"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                word, hashes = value.as_py(), []
                n = len(word)
                for modulus, base in PRIMES:
                    ahead, power = [0], [1]
                    for letter in word:
                        ahead.append((ahead[-1] * base + ord(letter)) % modulus)
                        power.append(power[-1] * base % modulus)
                    # the letters before i, then those after i; last the whole word
                    less = [((ahead[i] - ahead[i + 1]) * power[n - 1 - i] + ahead[n]) % modulus for i in range(n)]
                    hashes.append([*less, ahead[n]])
                columns = [pa.array([name.as_py()] * (n + 1)), pa.array([n] * (n + 1), pa.int64()),
                           pa.array([f"{x:x}.{y:x}" for x, y in zip(*hashes)]), pa.array([*range(n), -1], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "letters", "variant", "at"])

    variants = cut_lineage(words.mapInArrow(run, "id string, letters bigint, variant string, at bigint"), "spelling-variants")
    left, right = variants.alias("a"), variants.alias("b")
    replaced = left.join(right, F.expr("a.variant = b.variant AND a.at = b.at AND a.letters = b.letters AND a.id <> b.id")).where("a.at >= 0")
    shorter = left.where("a.at >= 0").join(right.where("b.at < 0"), F.expr("a.variant = b.variant AND a.letters = b.letters + 1"))
    both = [F.col("a.id").alias("id"), F.col("b.id").alias("near_id")]
    pairs = reduce(DataFrame.unionByName, [p.where(F.greatest("a.letters", "b.letters") > longest).select(*both) for p in (replaced, shorter)])
    pairs = pairs.unionByName(pairs.select(F.col("near_id").alias("id"), F.col("id").alias("near_id"))).distinct()
    named = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"))
    return pairs.join(words, "id").join(named, "near_id").select("word", "near")


def group_variants(words: DataFrame, ratio: int = RATIO, longest: int = LONGEST) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for `words(word, n)`, one row a word.

    The form of a word is its most frequent near word (ties: the first in code point order) if that is at least
    `ratio` (above 1) times as frequent, else null. The root is where following forms ends; since counts grow by
    `ratio` with every step, a few joins that double the steps reach it. An empty table gives an empty result; words
    are not null and differ.
    """
    words = cut_lineage(words.select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    near = trie_neighbours(words, longest).unionByName(long_neighbours(words, longest))
    near = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    best = best.select(F.col("word").alias("of"), "n_near", F.col("best.near").alias("form"), (-F.col("best.rank")).alias("form_n"))
    rows = words.join(best, F.col("word") == F.col("of"), "left")
    taken = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    rows = rows.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                       F.when(taken, F.col("form_n")).alias("form_n"))
    rows = cut_lineage(rows, "spelling-forms")
    most = rows.agg(F.max("form_n")).first()[0]
    roots = cut_lineage(rows.where("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("root")), "spelling-roots")
    steps = math.log(most, ratio) + 1 if most else 0
    for _ in range(max(0, math.ceil(math.log2(steps))) if steps > 1 else 0):
        ahead = roots.select(F.col("of").alias("via"), F.col("root").alias("further"))
        roots = cut_lineage(roots.join(ahead, F.col("root") == F.col("via"), "left").select("of", F.coalesce("further", "root").alias("root")), "spelling-roots")
    found = rows.join(roots, F.col("word") == F.col("of"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST,
                      ratio: int = RATIO, typo: int | None = None) -> DataFrame:
    """Variant groups of all words of `df` with at least `shortest` letters and `least` occurrences.

    Null and empty texts have no words, texts of any length are read whole, repeated rows count as often as they
    occur, other columns are ignored whatever their names, and an empty table gives an empty result.
    """
    return group_variants(count_words(df, key, text, shortest, typo).where(F.col("n") >= least), ratio)


VARIANTS_SQL = f"""
WITH RECURSIVE steps AS (  -- remainders of all bytes for CRC-32, from its polynomial
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS raw FROM documents),
lowered AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(raw) >= {SHORTEST} GROUP BY ALL),
bytes AS (
  SELECT *, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM lowered),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS h FROM bytes, steps),
spelled AS (
  SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
variants AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS variant FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM variants a JOIN variants b ON a.variant = b.variant AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM variants a JOIN words b ON a.variant = b.word
  UNION SELECT b.word, a.word, a.n FROM variants a JOIN words b ON a.variant = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN form_n >= {RATIO} * w.n THEN form END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN form_n >= {RATIO} * w.n THEN form_n END::BIGINT AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, word AS root, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON f.word = c.word WHERE c.form IS NULL
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents").select("doc_id", "text"), typo=TYPO)
