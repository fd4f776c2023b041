"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets.

A word is a binary vector with a bit for the k-th occurrence of each letter in it. One inserted or
deleted letter changes one bit, one replaced letter two. The bits are dealt into ``PARTS`` parts by a hash,
so two words of equal length that are near agree in all but two parts, and two whose lengths differ by one in all
but one. A signature is one such choice of parts together with the bits in them: every near
pair shares one, nothing is left to chance.

Words of equal length must besides agree in their first or in their second half, as one replaced
letter lies in one of them; the half goes into the signature and keeps buckets short. Words meet in an equi-join on a hash
of the signature and are verified by their edit distance before a pair leaves the join.
Nothing is broadcast: Spark takes the signatures for as large as the words before they were spread over sixteen rows each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.llm.common import stored

#: Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
#: Characters of text whose words are listed at a time.
BLOCK = 65_536
#: Parts that the bits of a vector are dealt into.
PARTS = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """Every run of letters in the texts (doc_id, run), A-Z as a-z; blocks of text never cut one."""
    block = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}+[{LETTERS}]*+"), F.lit(0))
    blocks = docs.select("doc_id", F.explode(block).alias("block"))
    run = F.regexp_extract_all(F.translate("block", UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))
    return blocks.select("doc_id", F.explode(run).alias("run"))


def slipped(found: DataFrame, every: int) -> DataFrame:
    """The runs as ``word``, one code point missing where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    h = found.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def _parts(word: Column) -> Column:
    """The bits of a word's vector as text, one entry per part."""
    letters = F.array_sort(F.split(word, ""))
    bits = F.transform(letters, lambda x, i: F.concat(x, (i + 1 - F.array_position(letters, x)).cast("string")))
    part = lambda p: F.filter(bits, lambda b: F.crc32(b.cast("binary")) % PARTS == p)
    return F.array(*[F.array_join(part(p), " ") for p in range(PARTS)])


def signatures(words: DataFrame, side: str) -> DataFrame:
    """Signatures (key, word, n) of words (word, n) on the ``left`` or ``right`` of the join.

    Equal lengths meet in the same keys on both sides; besides these a word is the shorter one on the left
    and the longer one on the right.
    """
    cut = F.floor(F.length("word") / 2).cast("int")
    halves = [("<", F.col("word").substr(F.lit(1), cut)), (">", F.col("word").substr(cut + 1, F.length("word")))]
    base = words.select("word", "n", F.length("word").alias("size"), _parts(F.col("word")).alias("parts"))

    def chosen(keep: tuple[int, ...]) -> list[Column]:
        return [F.lit(repr(keep)), *[F.col("parts")[p] for p in keep]]

    equal = [
        F.xxhash64(F.lit(mark), "size", half, *chosen(keep)) for keep in combinations(range(PARTS), PARTS - 2) for mark, half in halves
    ]
    shorter = F.col("size") if side == "left" else F.col("size") - 1
    longer = [F.xxhash64(F.lit("+"), shorter, *chosen(keep)) for keep in combinations(range(PARTS), PARTS - 1)]
    return base.select(F.explode(F.array(*equal, *longer)).alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """Both directions of every pair one edit apart among distinct words (word, n): word, n, near, near_n."""
    left = signatures(words, "left").alias("l")
    right = signatures(words, "right").alias("r")
    fits = (
        (F.col("l.key") == F.col("r.key"))
        & ((F.length("l.word") < F.length("r.word")) | ((F.length("l.word") == F.length("r.word")) & (F.col("l.word") < F.col("r.word"))))
        & (F.levenshtein("l.word", "r.word", 1) == 1)
    )
    pairs = left.join(right.hint("merge"), fits).select(F.col("l.word").alias("a"), F.col("l.n").alias("an"), F.col("r.word").alias("b"), F.col("r.n").alias("bn"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    # a pair shares several signatures
    return pairs.distinct().select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """The last word reached from each word (word, form) by following forms, which must not run in circles.

    Pointers are doubled, so a chain of k forms takes log2(k) rounds.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = state.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ahead = stored(ahead, "roots")
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        state = ahead.select("word", "root")


def spelling_variants(docs: DataFrame, every: int = 199, length: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """One row per frequent word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words have at least ``length`` code points and ``often`` occurrences n in all texts together. ``n_near`` counts the
    words one edit away. ``form`` is the most frequent of them (of equals the smallest in code-point
    order) if it occurs ``times`` times as often as the word, else null, and ``form_n`` its occurrences.
    ``root`` is the last word reached over forms, the word itself without one.

    A null text has no words, an empty one neither; a null id counts as empty text where the id matters. Repeated
    rows count each time. A text of any length is read in blocks. Other columns are not read. No rows give none.
    """
    counts = slipped(runs(docs.select("doc_id", "text")), every).groupBy("word").agg(F.count("*").alias("n"))
    words = stored(counts.where((F.col("n") >= often) & (F.length("word") >= length)), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    follows = -F.col("best.m") >= F.lit(times) * F.col("n")
    near = near.select(
        "word",
        "n_near",
        F.when(follows, F.col("best.form")).alias("form"),
        F.when(follows, -F.col("best.m")).alias("form_n"),
    )
    near = stored(near, "near")
    ends = roots(near.where("form is not null"))
    return (
        words.join(near.hint("merge"), "word", "left")
        .join(ends.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in DuckDB, bit by bit."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, s: xor(v >> 1, (v & 1) * 3988292384))"
    data = f"list_transform(range(strlen({text})), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {bits}), 4294967295)"


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, times, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(times)::BIGINT AS n FROM hashed GROUP BY 1
), often AS (
  SELECT word, n FROM words WHERE n >= 5 AND length(word) >= 6
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM often)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT h.word, h.n, o.word, o.n FROM holes h JOIN often o ON h.rest = o.word
  UNION SELECT o.word, o.n, h.word, h.n FROM holes h JOIN often o ON h.rest = o.word
), best AS (
  SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near
), forms AS (
  SELECT o.word, o.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= 5 * o.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 5 * o.n THEN b.other_n END AS form_n
  FROM often o LEFT JOIN best b ON o.word = b.word AND b.r = 1
), ends AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL
  SELECT f.word, e.root FROM forms f JOIN ends e ON f.form = e.word
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
