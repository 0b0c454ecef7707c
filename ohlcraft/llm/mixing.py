"""Mixing sources to target weights: hierarchical token budgets, and a token-prefix of each leaf.

The leaves are (domain, language, source). A token budget goes down the tree: at each node it is
shared among the children in proportion to their weights, but no child gets more than its subtree
can supply (its tokens times the allowed epochs). What a child can't take goes to its siblings, by
their weights; only what all siblings together can't take is felt one level up, where the node as
a whole supplies less and its own siblings take the rest. All shares are whole numbers of tokens,
rounded down. Everything here is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, text_of

LEVELS = ("domain", "lang", "source")
#: White-space-separated words.
WORDS = r"[^\x20\x09-\x0D]+"


def _weight(col: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(col)), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds ``got``: the part of ``budget`` (of the parent) for each child with ``cap`` and ``w``.

    Children are filled in the order of cap / w. A child is full if its cap is no more than its part
    of what the fuller ones before it leave; the rest share the remainder by weight.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    order = group.orderBy(F.col("cap") / F.col("w"), F.col(child))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("cap") * F.col("rest") <= F.col("w") * (F.col("budget") - F.col("before"))
    n = nodes.where("w > 0").withColumns({"before": before, "rest": rest}).withColumn("full", full)
    n = n.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(group))
    return n.withColumn("got", F.expr("CASE WHEN full THEN cap ELSE (w * greatest(budget - taken, 0)) div open END")).drop("before", "rest", "full", "taken", "open")


def leaf_budgets(leaves: DataFrame, fraction: float, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves with tokens.

    The whole budget is ``fraction`` of all tokens, in hundredths rounded down to whole tokens.
    """
    a, b, c = LEVELS
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(epochs))
    top = caps.groupBy(a).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(a, weights.get(a, {})))
    whole = caps.groupBy().agg(F.expr(f"coalesce(sum(tokens), 0) * {round(fraction * 100)} div 100").alias("budget"))
    top = _share(top.crossJoin(F.broadcast(whole)), [], a).select(a, F.col("got").alias("budget"))  # one row on the other side
    mid = caps.groupBy(a, b).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(b, weights.get(b, {}))).join(top, a)
    mid = _share(mid, [a], b).select(a, b, F.col("got").alias("budget"))
    low = caps.withColumn("w", _weight(c, weights.get(c, {}))).join(mid, [a, b])
    return _share(low, [a, b], c).select(a, b, c, "tokens", F.col("got").alias("budget"))


def _hash(seed: int, k: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def leaf_cuts(rows: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """(domain, lang, source, k, cut_h, cut_id, cut_tokens, cut_take): where each leaf's budget ends.

    A leaf whose budget is k times its tokens and a rest gives all documents in epochs 0 to k - 1,
    and in epoch k the longest prefix that fits the rest. An epoch's order is that of
    md5(seed:epoch:id), then id (null first) and tokens. All rows before (cut_h, cut_id, cut_tokens) belong to the
    prefix, and cut_take of those equal to it. No leaf is sorted whole: sums by the first two bytes of
    the hash tell which 65,536th of the leaf holds the cut, and there equal rows are counted
    before they are ordered, so that repeated ids (all null ones have one hash) are a row each number of tokens.
    """
    leaf = list(LEVELS)
    b = budgets.where("budget > 0 AND tokens > 0").select(*leaf, F.expr("budget div tokens").cast("int").alias("k"), F.expr("budget % tokens").alias("rest"))
    b, _ = materialize(b, "mix-budgets")
    part = rows.join(b, leaf).withColumn("h", _hash(seed, F.col("k"), F.col("id")))
    for at in (1, 3):  # a byte of the hash at a time
        bucket = F.substring("h", at, 2)
        sums = part.groupBy(*leaf, bucket.alias("bucket")).agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))
        # the cut lies in the first bucket that goes over the rest: the rest is less than the leaf
        cut = sums.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min("bucket").alias("cut"), F.min(F.col("upto") - F.col("n")).alias("used"))
        cut, _ = materialize(cut, "mix-cuts")
        part = part.join(cut, leaf).where(bucket == F.col("cut")).withColumn("rest", F.col("rest") - F.col("used")).drop("cut", "used")
    same = part.groupBy(*leaf, "k", "rest", "h", "id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    key = ("h", F.col("id").asc_nulls_first(), "tokens")
    before = F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(Window.partitionBy(*leaf).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = same.withColumn("before", before).where(F.col("before") + F.col("n") * F.col("tokens") > F.col("rest"))
    first = F.row_number().over(Window.partitionBy(*leaf).orderBy(*key))
    over = over.withColumn("nth", first).where("nth = 1")
    return over.select(*leaf, "k", F.col("h").alias("cut_h"), F.col("id").alias("cut_id"), F.col("tokens").alias("cut_tokens"), F.expr("(rest - before) div tokens").alias("cut_take"))


def _against_cut(h: Column, row_id: Column, tokens: Column, of=F.col) -> tuple[Column, Column]:
    """(whether a row comes before its leaf's cut, whether it is equal to it)."""
    same_h, same_id = h == of("cut_h"), row_id.eqNullSafe(of("cut_id"))
    earlier_id = F.coalesce(row_id < of("cut_id"), row_id.isNull() & of("cut_id").isNotNull())
    # tokens are looked at for rows with the cut's id alone
    before = F.when(same_h & same_id, tokens < of("cut_tokens")).otherwise((h < of("cut_h")) | same_h & earlier_id)
    return before, F.when(same_h & same_id, tokens == of("cut_tokens")).otherwise(F.lit(False))


def select_prefixes(rows: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """(id, domain, lang, source, tokens, epoch): the documents that fill each leaf's budget, by :func:`leaf_cuts`."""
    leaf = list(LEVELS)
    cuts, _ = materialize(leaf_cuts(rows, budgets, seed), "mix-leaf-cuts")
    r = rows.join(cuts, leaf).withColumn("h", _hash(seed, F.col("k"), F.col("id")))
    before, _ = _against_cut(F.col("h"), F.col("id"), F.col("tokens"))
    # epochs 0 to k - 1, and k for those before the cut
    many = r.withColumn("last", F.col("k") - F.when(before, 0).otherwise(1)).where("last >= 0")
    taken = many.select("id", *leaf, "tokens", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("epoch"))
    equal = cuts.where("cut_take > 0").select(F.col("cut_id").alias("id"), *leaf, F.col("cut_tokens").alias("tokens"), F.col("k").alias("epoch"), F.explode(F.sequence(F.lit(1), F.col("cut_take"))).alias("nth"))
    return taken.unionByName(equal.drop("nth"))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    fraction: float = 0.5,
    epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(id_col, domain, lang, source, tokens, epoch): one row for each document and epoch chosen.

    ``weights`` holds whole-number weights by level ("domain", "lang", "source") and name; a name
    without one has weight 1, a weight of 0 shuts a node out. Tokens are white-space-separated words
    of the whole text; a null text has none. Null labels count as the label ''. A leaf without
    tokens gives nothing. Null and repeated ids are rows like any other, ordered by their hash. An
    empty table gives an empty result.
    """
    rows, leaves = _rows_and_leaves(docs, domain, id_col, text_col, lang_col, source_col)
    chosen = select_prefixes(rows, leaf_budgets(leaves, fraction, epochs, weights), seed)
    return chosen.select(F.col("id").alias(id_col), *LEVELS, "tokens", F.col("epoch").cast("long").alias("epoch"))


def _label(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _tokens(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORDS)).cast("long")


def _rows_and_leaves(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(id_col).alias("id"), _label(domain).alias("domain"), _label(F.col(lang_col)).alias("lang"), _label(F.col(source_col)).alias("source"), _tokens(text_col).alias("tokens"))
    rows, _ = materialize(rows, "mix-rows")
    leaves, _ = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    return rows, leaves


#: The production setting over ``documents``, whose sources are named by number.
DOMAINS = ("web", "books", "forum", "code")
WEIGHTS = {"domain": {"web": 4, "books": 3, "forum": 2, "code": 1}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}}


def domain_of(source_col: str = "source") -> Column:
    """A domain for a source, from the number in its name; '' without one."""
    number = F.regexp_extract(F.coalesce(F.col(source_col), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number != "", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.pmod(F.expr("try_cast(" + f"regexp_extract(coalesce(`{source_col}`, ''), '([0-9]{{1,9}})$', 1)" + " AS INT)"), F.lit(len(DOMAINS))) + 1).cast("int"))).otherwise("")


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, domain_of(), WEIGHTS)


def mixed_rows(docs: DataFrame, fraction: float = 0.5, epochs: int = 2, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix_documents` takes them, with the columns of ``docs``.

    Each row tells by its own hash whether it is before its leaf's cut, so that texts aren't shuffled. Of rows equal to
    the cut (repeated ids with as many tokens in one leaf) the first ones by a hash of all columns are taken.
    """
    rows, leaves = _rows_and_leaves(docs, domain_of(), "doc_id", "text", "lang", "source")
    cuts, _ = materialize(leaf_cuts(rows, leaf_budgets(leaves, fraction, epochs, WEIGHTS), seed), "mix-leaf-cuts")
    names = {c: fresh(docs, f"__{c}") for c in (*LEVELS, "k", "cut_h", "cut_id", "cut_tokens", "cut_take")}
    h, nth, times = (fresh(docs, n) for n in ("__h", "__nth", "__times"))
    cuts = cuts.withColumnsRenamed(names)
    of = lambda c: F.col(names[c])
    labels = {names["domain"]: _label(domain_of()), names["lang"]: _label(F.col("lang")), names["source"]: _label(F.col("source"))}
    # the cuts have a row a leaf: the planner broadcasts them by their written size
    r = docs.withColumns(labels).join(cuts, [names[c] for c in LEVELS]).withColumn(h, _hash(seed, of("k"), F.col("doc_id")))
    row_id, tokens = F.col("doc_id"), _tokens("text")
    before, equal = _against_cut(F.col(h), row_id, tokens, of)
    sure = r.withColumn(times, of("k") + F.when(before, 1).otherwise(0)).where(F.col(times) > 0).where(~equal)
    number = F.row_number().over(Window.partitionBy(*[names[c] for c in LEVELS]).orderBy(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])))
    at_cut = r.where(equal).withColumn(nth, number).withColumn(times, of("k") + F.when(F.col(nth) <= of("cut_take"), 1).otherwise(0)).where(F.col(times) > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    copies = F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth)
    return sure.select(*columns, copies).unionByName(at_cut.select(*columns, copies)).drop(nth)


_SHARE = """
{name}_a AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {by} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source}),
{name}_b AS (SELECT *, cap * rest <= w * (budget - before) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {by}), 0) AS taken, sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {by}) AS open FROM {name}_b),
{name} AS (SELECT {keys}, {more} CASE WHEN is_full THEN cap ELSE (w * greatest(budget - taken, 0)) // open END AS budget FROM {name}_c)"""


def _case(col: str) -> str:
    found = WEIGHTS.get(col, {})
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in found.items()) + " ELSE 1 END" if found else "1"


ORACLE = (
    r"""
WITH named AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS num,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
rows_ AS (SELECT doc_id, lang, source, tokens, CASE WHEN num = '' THEN '' ELSE ['web', 'books', 'forum', 'code'][CAST(num AS BIGINT) % 4 + 1] END AS domain FROM named),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, 2 * sum(tokens)::HUGEINT AS cap FROM rows_ GROUP BY ALL),
total AS (SELECT (coalesce(sum(tokens), 0) * 50) // 100 AS budget FROM leaves),
top_in AS (SELECT domain, sum(cap)::HUGEINT AS cap, """
    + _case("domain")
    + r""" AS w, any_value(budget) AS budget FROM leaves, total GROUP BY domain),"""
    + _SHARE.format(name="top", by="1", child="domain", source="top_in", keys="domain", more="")
    + r""",
mid_in AS (SELECT l.domain, l.lang, sum(cap)::HUGEINT AS cap, """
    + _case("lang").replace("lang", "l.lang", 1)
    + r""" AS w, any_value(budget) AS budget FROM leaves l JOIN top USING (domain) GROUP BY l.domain, l.lang),"""
    + _SHARE.format(name="mid", by="domain", child="lang", source="mid_in", keys="domain, lang", more="")
    + r""",
low_in AS (SELECT l.domain, l.lang, l.source, tokens, cap, 1 AS w, budget FROM leaves l JOIN mid USING (domain, lang)),"""
    + _SHARE.format(name="low", by="domain, lang", child="source", source="low_in", keys="domain, lang, source", more="tokens,")
    + r""",
goal AS (SELECT domain, lang, source, CAST(budget // tokens AS INTEGER) AS k, budget % tokens AS rest FROM low WHERE budget > 0 AND tokens > 0),
hashed AS (SELECT r.*, k, rest, md5('42:' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM rows_ r JOIN goal USING (domain, lang, source)),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM hashed)
SELECT doc_id, domain, lang, source, tokens, CAST(k AS BIGINT) AS epoch FROM cum WHERE upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(k)) AS BIGINT) AS epoch FROM hashed WHERE k > 0
"""
)
