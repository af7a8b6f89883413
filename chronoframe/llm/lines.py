"""Line dedup with a log-template tree, in DataFrame operations only.

A line descends a tree of fixed depth: its token count, then its leading tokens,
with every token that holds a digit generalised to ``<*>``. In a leaf, the token
that more than half of the leaf's distinct lines have at a position is constant,
any other position is a variable field; a line that agrees with at least
four fifths of its positions with those constants belongs to the leaf's
template. The others of the leaf are grouped by equal parts of their tokens, and
each group can hold a template by the same rule; a line may be in several. A
line that fits none is a template of its own. Two templates that share one part
only, and all its lines, are still seen as one group.

A template that occurs in two or more documents recurs. It stays in its first
document (lowest doc_id) and its lines are dropped from all others, so a passage
that many documents share survives once; a line of several templates goes if the
first document of any of them is another, and is near one that stays or went so.

Sizes: only lines in leaves with several distinct lines are exploded to tokens;
counts are pre-aggregated; lines of a leaf meet only its constants, a row a leaf,
in joins that Spark can split where a leaf is large; nothing is broadcast by hand.

Cases: null text stays null; empty lines are never dropped; rows of one doc_id
are one document; rows with a null doc_id are one document for each different
text; repeats within one document stay; a document all of whose lines go keeps an
empty text (``drop_lines``); other columns pass through whatever their names, and
a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free_name, materialize

#: A line belongs to a template if 4 of 5 positions agree.
DEPTH, AGREE, OF = 4, 4, 5
#: A token with a digit in it.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def _keyed(docs: DataFrame) -> DataFrame:
    """text; row: all columns; _doc: the document's number; _text: tells rows of one number apart."""
    text = F.xxhash64("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("text", row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.shiftright(text, 1)) - 1).alias("_doc"), text.alias("_text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """Occurrences: _doc, _text, pos, n, leaf, line and the masked line."""
    split = keyed.select("_doc", "_text", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    split = split.where(F.col("raw").rlike(r"[^\s\x{A0}]"))  # on the raw line: a filter on what is made of it would make it twice
    spaced = F.when(F.col("raw").rlike(r"[\t-\r\x{A0}]|  "), F.regexp_replace("raw", r"[\s\x{A0}]+", " ")).otherwise(F.col("raw"))
    masked = F.when(F.col("spaced").rlike("[0-9]"), F.regexp_replace("spaced", VARIABLE, "<*>")).otherwise(F.col("spaced"))
    cut = split.withColumn("spaced", F.trim(spaced)).withColumn("masked", masked)
    cut = cut.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return cut.select(
        "_doc", "_text", "pos", "n",
        F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"),
        F.xxhash64("masked", "n").alias("line"),
        "masked",
    )


def templates(lines: DataFrame) -> DataFrame:
    """line, template, for the distinct lines that fit a template with others: one of their leaf, or else any of its groups."""
    several = materialize(lines.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("leaf"), "several")  # written, so that the join below can be split where a leaf is large
    met = lines.join(several.hint("merge"), "leaf", "left_semi").select("leaf", "n", "line", "masked")
    distinct = met.groupBy("line").agg(F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.min("masked").alias("masked"))
    shared = materialize(distinct.withColumn("tokens", F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).drop("masked"), "leaves")
    whole = materialize(_fit(shared), "leaf-templates")
    parts = materialize(_groups(shared.join(whole, "line", "left_anti")), "leaf-groups")
    return whole.union(_fit(parts))


def _fit(lines: DataFrame) -> DataFrame:
    """line, template, for the lines that agree with the constants of their leaf."""
    token = lines.select("leaf", F.posexplode("tokens").alias("pos", "token"))
    counted = token.groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    most = counted.groupBy("leaf", "pos").agg(F.max(F.struct("c", "token")).alias("most")).select("leaf", "pos", "most.c", "most.token")
    sizes = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    constants = most.join(sizes, "leaf").where("2 * c > size").groupBy("leaf").agg(F.collect_list(F.struct("pos", "token")).alias("constants"))  # at most one a position
    agree = F.expr("aggregate(constants, 0, (a, c) -> a + CASE WHEN tokens[c.pos] = c.token THEN 1 ELSE 0 END)")
    return lines.join(constants, "leaf").where(agree * OF >= F.col("n") * AGREE).select("line", F.xxhash64("leaf", F.lit("template")).alias("template"))


def _groups(rest: DataFrame) -> DataFrame:
    """``rest`` with each group of lines of a leaf that are equal in a part, as a leaf of its own.

    The tokens after the leading ones are cut into more parts than lines of enough
    similarity can differ in, so two such lines are in a group together.
    """
    differ = F.call_function("div", F.col("n") * (OF - AGREE), F.lit(OF))
    wide = rest.withColumn("width", F.greatest(F.lit(1), F.floor((F.col("n") - DEPTH) / (differ + 1))).cast("int"))
    part = F.transform(F.sequence(F.lit(DEPTH), F.col("n") - 1, F.col("width")), lambda i: F.xxhash64("leaf", i, F.slice("tokens", i + 1, F.col("width"))))
    keys = wide.where(F.col("n") > DEPTH).select("line", F.explode(part).alias("part"))
    sets = keys.groupBy("part").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.bit_xor("line").alias("x"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    one = sets.groupBy("lo", "hi", "x", "c").agg(F.min("part").alias("part")).select("part")  # of the parts with the same lines
    return keys.join(one, "part").join(rest.drop("leaf"), "line").withColumnRenamed("part", "leaf")


def recurring(lines: DataFrame) -> DataFrame:
    """line, home: the distinct lines whose template is in two or more documents, and its first document."""
    span = lines.groupBy("line").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"))
    known = span.join(templates(lines), "line", "left").withColumn("template", F.coalesce("template", "line"))
    home = known.groupBy("template").agg(F.min("lo").alias("home"), F.max("hi").alias("last")).where("home <> last")
    return known.join(home, "template").groupBy("line").agg(F.min("home").alias("home"))


def mark_lines(docs: DataFrame) -> DataFrame:
    """text, row (all columns of ``docs``) and dropped (positions of the lines that go, or null)."""
    keyed = _keyed(docs)
    lines = materialize(_lines(keyed), "lines")
    again = materialize(recurring(lines), "recurring")
    gone = lines.join(again.hint("merge"), "line").where("_doc <> home").groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return keyed.join(gone, ["_doc", "_text"], "left").select("text", "row", "dropped")


def drop_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", most: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` without the dropped lines, with their numbers.

    With ``most`` (a, b) a document that would lose more than a of b characters
    keeps all its lines: it is a copy of others as a whole, not one that quotes them.
    """
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(dropped, i)), '\\n')")
    cut = mark_lines(docs).withColumn("left", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept))
    if most:
        whole = (F.char_length("text") - F.char_length("left")) * most[1] > F.char_length("text") * most[0]
        cut = cut.select("text", "row", F.when(~F.coalesce(whole, F.lit(False)), F.col("dropped")).alias("dropped"), F.when(whole, F.col("text")).otherwise(F.col("left")).alias("left"))
    old = [F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    first = free_name(docs.columns, n_lines)
    second = free_name([*docs.columns, first], n_dropped)
    return cut.select(*old, F.size(F.split("text", "\n")).cast("long").alias(first), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias(second))


#: The same in SQL, over hashes' inputs instead of hashes.
ORACLE = rf"""
WITH occ0 AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL
), occ1 AS (
  SELECT doc_id, pos, trim(array_to_string(list_transform(string_split(regexp_replace(raw, '[\s\x{{A0}}]+', ' ', 'g'), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' '), ' ') AS masked FROM occ0
), occ AS (SELECT doc_id, pos, masked FROM occ1 WHERE masked <> ''
), span AS (
  SELECT masked, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n, array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ') AS lead, min(doc_id) AS lo, max(doc_id) AS hi
  FROM occ GROUP BY masked
), met AS (SELECT masked, tokens, n, n || ' ' || lead AS leaf FROM span QUALIFY count(*) OVER (PARTITION BY n, lead) > 1
), tok1 AS (SELECT leaf, n, masked, unnest(range(n)) AS p, unnest(tokens) AS t FROM met
), size1 AS (SELECT leaf, count(*) AS size FROM met GROUP BY 1
), con1 AS (SELECT leaf, p, t FROM tok1 JOIN size1 USING (leaf) GROUP BY leaf, size, p, t HAVING 2 * count(*) > size
), fit1 AS (SELECT masked, 'leaf ' || leaf AS template FROM tok1 JOIN con1 USING (leaf, p, t) GROUP BY leaf, n, masked HAVING {OF} * count(*) >= {AGREE} * n
), rest AS (
  SELECT *, greatest(1, (n - {DEPTH}) // (n * {OF - AGREE} // {OF} + 1)) AS width FROM met WHERE n > {DEPTH} AND masked NOT IN (SELECT masked FROM fit1)
), part AS (
  SELECT masked, n, tokens, leaf || ' part ' || i || ' ' || array_to_string(tokens[i + 1:i + width], ' ') AS leaf FROM (SELECT *, unnest(range({DEPTH}, n, width)) AS i FROM rest)
), size2 AS (SELECT leaf, count(*) AS size FROM part GROUP BY 1 HAVING count(*) > 1
), tok2 AS (SELECT leaf, size, n, masked, unnest(range(n)) AS p, unnest(tokens) AS t FROM part JOIN size2 USING (leaf)
), con2 AS (SELECT leaf, p, t FROM tok2 GROUP BY leaf, size, p, t HAVING 2 * count(*) > size
), fit2 AS (SELECT masked, leaf AS template FROM tok2 JOIN con2 USING (leaf, p, t) GROUP BY leaf, n, masked HAVING {OF} * count(*) >= {AGREE} * n
), fit AS (SELECT * FROM fit1 UNION ALL SELECT * FROM fit2
), known AS (SELECT span.masked, lo, hi, coalesce(template, 'line ' || span.masked) AS template FROM span LEFT JOIN fit ON span.masked = fit.masked
), home AS (SELECT template, min(lo) AS home FROM known GROUP BY 1 HAVING min(lo) <> max(hi)
), line AS (SELECT masked, min(home) AS home FROM known JOIN home USING (template) GROUP BY 1
), gone AS (SELECT doc_id, pos FROM occ JOIN line USING (masked) WHERE doc_id <> home
), cut AS (
  SELECT occ0.doc_id, string_agg(raw, chr(10) ORDER BY occ0.pos) FILTER (WHERE gone.pos IS NULL) AS text, count(gone.pos) AS n_dropped
  FROM occ0 LEFT JOIN gone ON gone.doc_id = occ0.doc_id AND gone.pos = occ0.pos GROUP BY 1
)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(cut.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(cut.text, '') END AS text
FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
