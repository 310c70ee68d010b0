"""Line deduplication within an edit distance of one, by a deletion-neighbourhood join.

Two lines are one edit apart if and only if they agree after deleting the same position of both (a substitution), or one
is the other with a position deleted.  So each line emits its deletion variants as hashed keys, equal keys meet, the edit
distance is verified on the lines themselves, and a line goes if an equal or near-equal line stands earlier, by
(doc_id, line number).

Emitting every variant of every line would multiply the corpus by the length of its lines.  Deletions are therefore
narrowed down first, without losing any: if lines are cut into blocks, two lines one edit apart agree on all but one
block.  Keys of "all but block b" that only one distinct line has rule that block out.  Halves are tried on all lines;
what is left goes on as pieces, a block with a key of all that stands around it, and pieces are cut into eighths again
and again until they are short.  Only then are variants emitted, of the piece and not of the line, so that the work
follows the length of a line and not its square.

No group is spelled out as pairs: every variant group is reduced to its earliest lines, and members are held against
those.

With ``max_words`` 1, lines of 100 characters and more also go if an earlier one differs by one word: replaced, put in or
left out, whatever its edits.  It is the same join with words for characters; candidates share their first or their last
40 characters, as one word cannot reach into both.

Lines are what newlines separate; characters are code points.  Defined results: lines of fewer than ``least`` characters
(headings, brackets, blanks) are never dropped; a text whose lines all go becomes empty; null texts stay null; rows with
a null doc_id are left as they are; rows that repeat a doc_id and its text count as the same place, so both keep a line
whose earliest place that is; all columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, scratch, table

#: Shortest line, in characters, that is compared within an edit distance.
LEAST = 16
COARSE, FINE = 2, 8
#: Pieces of so many characters (or words) are short: their variants are emitted.
SHORT = 12
#: Lines of so many characters are also compared by words; of longer words, pieces of WORD characters count as words.
LONG, WORD = 100, 20
#: Characters at either end, outside which or before which a changed word and its blank must lie.
END = (LONG - WORD) // 2
#: Keys that may be broadcast (12 bytes each); more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000

_PLACE = ["doc_id", "text_hash", "line_no"]


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, line_no, line and its 96-bit hash (h1, h2), for lines of ``least`` characters or more."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") >= least).withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line")})


def _block(size: Column, blocks: int, b: int) -> tuple[Column, Column]:
    """First character (from 0) and end of block ``b`` of a line of ``size`` characters."""
    return F.floor(size * b / blocks).cast("int"), F.floor(size * (b + 1) / blocks).cast("int")


#: Size of a line's parts, and ``n`` of them from ``at`` (from 0): its characters, or its words as an array.
Unit = tuple[Callable[[Column], Column], Callable[..., Column]]
CHARACTERS: Unit = (F.length, lambda parts, at, n: F.substring(parts, at + 1, n))
WORDS: Unit = (F.size, lambda parts, at, n: F.slice(parts, at + 1, F.greatest(n, F.lit(0))))


def words_of(line: Column) -> Column:
    """The words with the blank behind them, longer ones in pieces of ``WORD`` characters."""
    return F.regexp_extract_all(F.concat(line, F.lit(" ")), F.lit(f"[^ ]{{1,{WORD}}} ?| "), F.lit(0))


def blocks_of(parts: Column, over: Column, blocks: int, unit: Unit = CHARACTERS, around: Column | None = None) -> Column:
    """Each block of ``parts``, as an array of structs: ``part``, and ``key`` of all that stands around it.

    ``over`` is 1 where the line is taken for the longer one of two: each block is then one part longer, and its keys
    are those of the shorter line.  ``around`` is the key of what stands around ``parts``.
    """
    size, cut = unit
    short = size(parts) - over
    found = []
    for b in range(blocks):
        start, end = _block(short, blocks, b)
        key = F.xxhash64(*([] if around is None else [around]), short, F.lit(b), cut(parts, F.lit(0), start), F.lit("|"), cut(parts, end + over, size(parts)))
        found.append(F.struct(key.alias("key"), cut(parts, start, end + over - start).alias("part")))
    return F.array(*found)


def block_keys(parts: Column, blocks: int) -> Column:
    """Keys of all but each block, for the line as the shorter and as the longer one of two."""
    return F.concat(blocks_of(parts, F.lit(0), blocks)["key"], blocks_of(parts, F.lit(1), blocks)["key"])


def end_keys(line: Column) -> Column:
    """Keys of the first and of the last ``END`` characters: in a line of ``LONG``, no one word reaches into both."""
    return F.array(F.xxhash64(F.lit("head"), F.substring(line, 1, END)), F.xxhash64(F.lit("tail"), F.substring(line, -END, END)))


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether different arrays agree without one word of the longer one, or without the word at one place of both."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    rest = F.least(F.size(a), F.size(b)) - at + (F.size(a) != F.size(b)).cast("int")
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (F.slice(a, F.size(a) - rest + 1, rest) == F.slice(b, F.size(b) - rest + 1, rest))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether different strings agree without one character of the longer one, or without the one at one place of both."""

    least = F.least(F.length(a), F.length(b))

    def further(shared: Column, step: Column) -> Column:  # halving steps find the common beginning
        alike = (shared + step <= least) & (F.substring(a, shared + 1, step) == F.substring(b, shared + 1, step))
        return shared + F.when(alike, step).otherwise(0)

    steps = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    begin = F.aggregate(F.filter(steps, lambda step: step <= least), F.lit(0), further)
    rest = lambda x, y: F.substring(x, begin + 1 + (F.length(x) >= F.length(y)).cast("int"), F.length(x))
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (rest(a, b) == rest(b, a))


def _shared(rows: DataFrame) -> DataFrame:
    """The keys that at least two different lines have (columns key, h1, h2)."""
    return rows.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("key")


def _having(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys``: broadcast only where a count proves it small."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, "key", "left_semi")


def _pieces(lines: DataFrame, unit: Unit) -> DataFrame:
    """h1, h2, first, over, key and part of the short pieces in which a line (column parts) may differ from another by one part."""
    size = unit[0]
    rows = lines.select("h1", "h2", "first", F.explode(F.array(F.lit(0), F.lit(1))).alias("over"), F.lit(0).cast("long").alias("key"), F.col("parts").alias("part")).where(size(F.col("part")) >= F.col("over"))
    blocks, ready = COARSE, None
    while True:
        cut = rows.select("h1", "h2", "first", "over", F.explode(blocks_of(F.col("part"), F.col("over"), blocks, unit, F.col("key"))).alias("b"))
        cut = cut.select("h1", "h2", "first", "over", "b.key", "b.part")
        rows = durable(cut.join(_shared(cut), "key", "left_semi"), "line-pieces")
        length = size(F.col("part")) - F.col("over")  # alike for both lines of a pair
        short = rows.where(length <= SHORT)
        ready = short if ready is None else ready.unionByName(short)
        rows, blocks = rows.where(length > SHORT), FINE
        if rows.isEmpty():
            return ready


def _near(lines: DataFrame, firsts: DataFrame, keys_of: Column, parts: Column, unit: Unit, apart: Callable[[Column, Column], Column]) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line one part away; such lines share one of ``keys_of``."""
    size, cut = unit
    coarse = lines.select("h1", "h2", F.explode(keys_of).alias("key"))
    keys = durable(_shared(coarse), "line-halves")
    near = _having(lines.select(*_PLACE, "line", "h1", "h2", F.explode(keys_of).alias("key")), keys).drop("key").distinct()
    near = near.join(firsts, ["h1", "h2"]).where(F.struct(*_PLACE) == F.col("first")).select("h1", "h2", "first", "line")
    near = durable(near.distinct().select("h1", "h2", "first", parts.alias("parts")), "line-candidates")

    pieces, part, key = _pieces(near, unit), F.col("part"), F.col("key")
    spots = pieces.where(size(part) > 0).select("*", F.explode(F.sequence(F.lit(0), size(part) - 1)).alias("at"))
    before, behind = cut(part, F.lit(0), F.col("at")), cut(part, F.col("at") + 1, size(part))
    role = lambda name, variant: (F.lit(name).alias("role"), variant.alias("key"))
    swapped = spots.where("over = 0").select("h1", "h2", "first", *role("swap", F.xxhash64(F.lit("swap"), key, size(part), "at", before, F.lit("|"), behind)))
    longer = spots.where("over = 1").select("h1", "h2", "first", *role("long", F.xxhash64(F.lit("gap"), key, F.concat(before, behind))))
    whole = pieces.where("over = 0").select("h1", "h2", "first", *role("short", F.xxhash64(F.lit("gap"), key, part)))
    variants = durable(swapped.unionByName(longer).unionByName(whole).distinct(), "line-variants")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("first"))).alias(role)
    earliest = variants.groupBy("key").agg(of("swap"), of("long"), of("short"), F.count("*").alias("rows")).where("rows > 1")
    # A long line is held against the short one, the short one against the earliest long one, equals against their first.
    rival = F.when(F.col("role") == "swap", F.col("swap")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("long"))
    claims = variants.join(earliest, "key").select("h1", "h2", "first", rival.alias("rival")).where(F.col("rival") < F.col("first")).distinct()
    parts_of = near.select(F.col("first").alias("rival"), F.col("parts").alias("rival_parts"))
    checked = claims.join(near.select("h1", "h2", "parts"), ["h1", "h2"]).join(parts_of, "rival").where(apart(F.col("parts"), F.col("rival_parts")))
    return durable(checked.select("h1", "h2").distinct(), "near-lines", keep=True)


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line one edit away."""
    return _near(lines, firsts, block_keys(F.col("line"), COARSE), F.col("line"), CHARACTERS, one_edit_apart)


def near_long_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines of ``LONG`` characters or more that have an earlier such line one word away."""
    return _near(lines.where(F.length("line") >= LONG), firsts, end_keys(F.col("line")), words_of(F.col("line")), WORDS, one_word_apart)


def dropped_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST, max_words: int = 0, least_equal: int | None = None) -> DataFrame:
    """doc_id, text_hash and line_no (from 0) of each line that goes."""
    if max_edits not in (0, 1) or max_words not in (0, 1):
        raise ValueError("the edit bound is 0 or 1, and so is that in words")
    lines = every = lines_of(docs, least)
    if least_equal is not None and least_equal < least:
        every = lines_of(docs, least_equal).where((F.length("line") >= least) | F.col("line").rlike(r"\S"))
    firsts = durable(every.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")), "line-firsts")
    gone = firsts.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    found = []
    for bound, search in ((max_edits, near_lines), (max_words, near_long_lines)):
        if bound:
            with scratch(docs.sparkSession):
                found.append(search(lines, firsts.select("h1", "h2", "first")))
    if found:
        near = reduce(DataFrame.unionByName, found).distinct()
        gone = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    rows = every.select(*_PLACE, "h1", "h2").join(gone, ["h1", "h2"])
    return rows.where(F.col("near") | (F.struct(*_PLACE) != F.col("first"))).select(*_PLACE)


def dedup_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST, max_words: int = 0, least_equal: int | None = None) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and columns n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    gone = dropped_lines(docs, max_edits, least, max_words, least_equal).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left")
    # The lines are a column of their own: within the lambda the text would be split again for each line that stays.
    split = rows.withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")), "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))}
    return split.withColumns(counts).withColumn("text", text).select(*docs.columns, "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(p)))::INT AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
firsts AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS f FROM lines WHERE length(line) >= 16 GROUP BY line),
variants AS (
  SELECT line, f, 's' AS kind, i, hash(substr(line, 1, i) || substr(line, i + 2)) AS v
  FROM (SELECT line, f, unnest(range(0, length(line))) AS i FROM firsts)),
near AS (
  SELECT DISTINCT a.line FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND b.f < a.f AND length(a.line) = length(b.line)
    WHERE levenshtein(a.line, b.line) = 1
  UNION SELECT a.line FROM variants a JOIN firsts b ON a.v = hash(b.line) AND b.f < a.f WHERE levenshtein(a.line, b.line) = 1
  UNION SELECT b.line FROM variants a JOIN firsts b ON a.v = hash(b.line) AND a.f < b.f WHERE levenshtein(a.line, b.line) = 1),
marked AS (
  SELECT l.*, coalesce(n.line IS NOT NULL OR f.f <> {'d': l.doc_id, 'n': l.line_no}, false) AS gone
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line),
texts AS (
  SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped, t.text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
