"""Fuzzy line dedup by MinHash in DataFrame functions only (operator 3).

A line is trimmed and lower-cased.  Its shingles are the ten characters from the
start of every word, from the ninth character of a word of 9 to 16, from every
character of a longer run but its last 16 (there every eighth, counted from the end, so that
an insertion does not shift the others) and from ideographs, kana and Hangul one by
one, so all of a line is covered.  One hash orders them; the signature is the
SIGNATURE smallest hashes.  Two lines of Jaccard similarity J share each of the
smallest hashes of their union with probability J.  Every two of a line's FIRST
smallest hashes form a band: two lines meet if they share two of the first five of
their union, which 0.993 of the pairs at J = 0.8 do, and more above.  Candidates are
verified by their exact Jaccard similarity, links go to the distributed union-find,
and the first line of every component, by document id and place, stays.

Equal lines are collapsed by a 128-bit hash before that.  A band in which more than
``crowd`` lines meet does not pair them all: its lines are banded again by every
three of all SIGNATURE hashes (0.995 of the pairs at J = 0.8), which parts lines that
only have common phrases in common.  What is still crowded then is a family of near
copies or of lines around one long template.  There each line is compared with the
first and the last of each of its bands, and in every eighth band with one member
drawn for the band, which brings most of a family together; ``crowds.py`` then finds
every link between those of its lines that are still apart.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.llm.components import components
from tracefp.llm.crowds import crowd_links
from tracefp.llm.store import fresh, settled

FIRST, SIGNATURE = 5, 7
# a piece that begins with an ideograph, kana or Hangul is one character, and so is one with 16 more to come in its run;
# any other run, and the end of a longer one, goes in pieces of eight
SHINGLE = r"(?=(.{1,10}))(?:[぀-﫿]|\S(?=\S{16})|\S{1,8})\s*"


def _plain(line: Column) -> Column:
    # the white space of the shingle pattern, so that what is left has a shingle
    return F.lower(F.trim(line, F.lit(" \t\x0b\f\r")))


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(SHINGLE), 1), lambda s: F.xxhash64(s)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is told by its id and the hash of its text: rows that repeat both are one."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").withColumn(
        "text_hash", F.xxhash64("text"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        F.struct("id", "text_hash", "pos").alias("at"), _plain(F.col("line")).alias("line")).where("line != ''")


def _bands(lines: DataFrame, size: int, of: int) -> DataFrame:
    """(key, line): one row for every ``size`` of a line's ``of`` smallest hashes, or one
    for all that it has."""
    def keys(n: int) -> Column:
        return F.array(*[F.xxhash64(*[F.col("signature")[i] for i in c]) for c in combinations(range(n), min(size, n))])

    made = keys(1)
    for n in range(2, of + 1):
        made = F.when(F.size("signature") >= n, keys(n)).otherwise(made)
    return lines.select(F.explode(made).alias("key"), "line")


def _met(bands: DataFrame, crowd: int, partitions: int, draw: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify and the lines (line) of crowded bands."""
    bands = bands.repartition(partitions, "key")
    drawn = F.min_by("line", F.xxhash64("key", "line")) if draw else F.min("line")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), drawn.alias("drawn")).where("n > 1")
    met = settled(bands.join(sizes, "key"), "bands")
    compared = F.array("low", "high", F.when(F.pmod("key", F.lit(8)) == 0, F.col("drawn")).otherwise(F.col("low")))
    ends = met.select("line", F.explode(F.array_distinct(compared)).alias("end")).where("line != end").select(
        F.least("line", "end").alias("a"), F.greatest("line", "end").alias("b"))
    few = met.where((F.col("n") > 3) & (F.col("n") <= crowd)).select("key", "line")
    inner = few.select("key", F.col("line").alias("a")).join(few.select("key", F.col("line").alias("b")), "key").where("a < b").select("a", "b")
    return ends.unionByName(inner).distinct(), met.where(F.col("n") > crowd).select("line").distinct()


def _instances(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, line, h1, h2) for every line that is not blank; ``at`` is a struct of id, hash
    of the document's text and line number from zero."""
    # xxhash64 chains its arguments: a constant in front is another seed
    return _exploded(_rows(docs, id_col, text_col)).select("at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, crowd: int = 24) -> DataFrame:
    """(h1, h2, keeper) for every different line: the place of the line that stays."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = _hashes(F.col("line"))
    signed = _instances(docs, id_col, text_col).withColumn("hashes", hashes).select(
        "h1", "h2", "at", F.slice(F.sort_array("hashes"), 1, SIGNATURE).alias("signature"), F.size("hashes").alias("n"))
    kinds = settled(signed.groupBy("h1", "h2").agg(F.min(F.struct("at", "signature", "n")).alias("m")).select(
        "h1", "h2", "m.at", "m.signature", "m.n", F.xxhash64("h1", "h2").alias("line")), "lines")
    pairs, crowded = _met(_bands(kinds, 2, FIRST), crowd, parts, False)
    again, still = _met(_bands(kinds.join(crowded, "line", "left_semi"), 3, SIGNATURE), crowd, parts, True)
    pairs = pairs.unionByName(again).distinct()
    # sets of sizes too different cannot be similar
    place = kinds.select("line", "at", "n")
    pairs = pairs.join(place.select(F.col("line").alias("a"), F.col("at").alias("at_a"), F.col("n").alias("n_a")), "a").join(
        place.select(F.col("line").alias("b"), F.col("at").alias("at_b"), F.col("n").alias("n_b")), "b")
    pairs = settled(pairs.where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")).select("a", "b", "at_a", "at_b"), "pairs")
    still = settled(place.join(still, "line", "left_semi").select("line", "at"), "crowded")
    ats = pairs.select(F.col("at_a").alias("at")).unionByName(pairs.select(F.col("at_b").alias("at"))).unionByName(still.select("at")).distinct()
    wanted = ats.groupBy("at.id", "at.text_hash").agg(F.collect_list("at.pos").alias("places"))
    texts = _rows(docs, id_col, text_col).join(wanted.hint("shuffle_hash").withColumnsRenamed({"id": "w_id", "text_hash": "w_hash"}),
                                               (F.col("text_hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id")))
    # used twice, so that the text is split once and not for every line
    texts = texts.select("id", "text_hash", F.split("text", "\n", -1).alias("lines"), "places")
    line_at = F.transform("places", lambda p: F.struct(p.alias("pos"), F.when(p < F.size("lines"), F.col("lines")[p]).alias("line")))
    shingles = settled(texts.select("id", "text_hash", F.inline(line_at)).select(
        F.struct("id", "text_hash", "pos").alias("at"), _hashes(_plain(F.col("line"))).alias("set")), "shingles")
    both = pairs.join(shingles.select(F.col("at").alias("at_a"), F.col("set").alias("set_a")), "at_a").join(
        shingles.select(F.col("at").alias("at_b"), F.col("set").alias("set_b")), "at_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = both.where(common >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")
    if not still.isEmpty():
        links = settled(links, "links")
        links = links.unionByName(crowd_links(still.join(shingles, "at").select(F.col("line").alias("node"), "set"), links, similarity))
    members = components(links).withColumnRenamed("node", "line").join(kinds.select("line", "at"), "line")
    members = members.join(members.groupBy("component").agg(F.min("at").alias("keeper")), "component").select("line", "keeper")
    return kinds.join(members, "line", "left").select("h1", "h2", F.coalesce("keeper", "at").alias("keeper"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, crowd: int = 24,
               n_chars_col: str | None = None) -> DataFrame:
    """docs with text_col left with the lines that stay, and n_lines, n_dropped.

    Of equal or similar lines anywhere in the table the first stays, by id (null
    first), then hash of the text, then place; blank lines stay.  A text all of whose
    lines go becomes empty; null text stays null with zero lines, empty text has one
    line, which is blank.  Rows that repeat id and text count once and get the same
    result.  n_chars_col, where named, becomes the length of the text that is left.
    Other columns pass through whatever their names: where docs has an n_lines or
    n_dropped, the new one gets leading underscores.  An empty table gives an empty table.
    """
    keepers = line_keepers(docs, id_col, text_col, similarity, crowd)
    instances = _instances(docs, id_col, text_col).select("at", "h1", "h2")
    doc_hash, gone_id, gone_hash, places = (fresh(docs, n) for n in ("doc_hash", "gone_id", "gone_hash", "places"))
    gone = settled(instances.join(keepers, ["h1", "h2"]).where("at != keeper").groupBy("at.id", "at.text_hash").agg(
        F.collect_set("at.pos").alias(places)).withColumnsRenamed({"id": gone_id, "text_hash": gone_hash}), "gone")
    keyed = docs.withColumn(doc_hash, F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(gone.hint("shuffle_hash"), (F.col(doc_hash) == F.col(gone_hash)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left")
    # used twice, so that a text is split once and not for every line
    lines = fresh(docs, "lines")
    joined = joined.withColumn(lines, F.split(F.col(text_col).cast("string"), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    new = {text_col: text} | ({n_chars_col: F.coalesce(F.length(text).cast("long"), F.col(n_chars_col))} if n_chars_col else {})
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns],
                         n_lines.alias(fresh(docs, "n_lines")), F.coalesce(F.size(places), F.lit(0)).alias(fresh(docs, "n_dropped")))


def op3_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped")
