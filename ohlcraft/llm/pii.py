"""Personal data: pattern spans, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each value found is a
protected entity. All words of its documents are terms; over the corpus, n(t, e) documents have both term t
and entity e, n(t) have the term at all, n(e) the entity, of N. The term's disclosure of the entity is
its pointwise mutual information over the entity's information content,

    log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

which is 1 if the term occurs only with the entity, 0 if they are independent. Terms at or over
REMOVE are removed, those at or over GENERALISE give way to the longest of their beginnings that discloses less: one that
more than n(e)^g N^(1-g) documents have can't disclose e by g or more, as n(t, e) is n(e) at most. A term without such a beginning
is removed. An entity counts from its first
document on; a word of the corpus counts from MIN_TERM documents on, as one met once can't be told
from chance. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Quantifiers that never give back what a match needs are possessive, and
# look-behinds keep the search from starting again inside a run that has failed, so that time and
# stack stay linear in the longest run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried at all.
_NEEDS = {"email": "instr({t}, '@') > 0", "ip": "{t} rlike '[0-9]\\\\.[0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "{t} rlike '[+][0-9]'"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Documents of a pair of entity class and term that are joined together.
_LANE = 1024
#: Documents of the corpus that must have a word, with an entity or not.
MIN_TERM = 2
REMOVE = 0.9
GENERALISE = 0.7
_TERM = r"\p{L}+"
_CHUNK = 64


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>>: matches of a pattern with code point offsets, end exclusive.

    Offsets are running sums of the lengths of the pieces between matches and of the matches, in
    chunks, so that texts with very many matches stay cheap.
    """
    return f"""
    transform(array(struct(regexp_extract_all({text}, {_sql(pattern)}, 0) AS m, split({text}, {_sql(pattern)}, -1) AS q)), z ->
      transform(array(transform(sequence(0, (size(z.m) - 1) div {_CHUNK}), c -> zip_with(slice(z.q, c * {_CHUNK} + 1, least({_CHUNK}, size(z.m) - c * {_CHUNK})), slice(z.m, c * {_CHUNK} + 1, {_CHUNK}), (a, b) -> struct(length(a) AS a, length(b) AS b, b AS v)))), chunks ->
        flatten(zip_with(chunks,
          aggregate(transform(chunks, ch -> aggregate(ch, 0, (n, x) -> n + x.a + x.b)), array(0), (acc, n) -> concat(acc, array(element_at(acc, -1) + n)), acc -> slice(acc, 1, size(acc) - 1)),
          (ch, base) -> aggregate(ch, struct(base AS p, cast(array() AS array<struct<s: int, e: int, v: string>>) AS o),
            (acc, x) -> struct(acc.p + x.a + x.b AS p, concat(acc.o, array(struct(acc.p + x.a AS s, acc.p + x.a + x.b AS e, x.v AS v))) AS o), acc -> acc.o))))[0])[0]"""


_NONE = "cast(array() AS array<struct<s: int, e: int, v: string>>)"


def located(text: str, pattern: str, needs: str = "true") -> str:
    return f"CASE WHEN {needs} AND regexp_instr({text}, {_sql(pattern)}) > 0 THEN {_located(text, pattern)} ELSE {_NONE} END"


def _valid(kind: str) -> str:
    """SQL for the condition on a match x.v of the kind."""
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"x.v rlike '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    value = "CASE WHEN y.i % 2 = 0 THEN y.d WHEN y.d > 4 THEN y.d * 2 - 9 ELSE y.d * 2 END"
    luhn = f"aggregate(transform(filter(split(reverse({digits}), ''), d -> d != ''), (c, i) -> struct(cast(c AS int) AS d, i AS i)), 0, (n, y) -> n + {value})"
    return f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} % 10 = 0 ELSE false END"


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__text`` (null: empty) and an array of spans (s, e, v) for each kind, named ``__<kind>``."""
    out = docs.withColumn("__text", text_of(text_col))
    for k in KINDS:
        found = located("__text", PATTERNS[k], _NEEDS[k].format(t="__text"))
        out = out.withColumn(f"__{k}", F.expr(f"filter({found}, x -> {_valid(k)})"))
    return out


def _entity(kind: str) -> str:
    """SQL for the entity of a span x: its kind and its value without spelling variants."""
    value = "lower(x.v)" if kind == "email" else "x.v" if kind == "ip" else "regexp_replace(x.v, '[^0-9]', '')"
    return f"concat('{kind}:', {value})"


def _masked(text: str) -> str:
    """SQL for the text with e-mail addresses blanked, so that their parts aren't taken for terms; the other kinds have no letters."""
    p = _sql(PATTERNS["email"])
    blank = f"array_join(zip_with(split({text}, {p}, -1), transform(regexp_extract_all({text}, {p}, 0), v -> repeat('0', length(v))), (a, b) -> concat(a, coalesce(b, ''))), '')"
    return f"CASE WHEN instr({text}, '@') > 0 THEN {blank} ELSE {text} END"


def _words(text: str) -> str:
    """SQL for the distinct terms of a text."""
    return f"array_distinct(transform(regexp_extract_all({_masked(text)}, {_sql(_TERM)}, 0), w -> lower(w)))"


def _classes(held: DataFrame) -> tuple[DataFrame, int]:
    """(id, h, ne, x, y) and the largest ne, from documents with their distinct ``entities``.

    Entities of the same documents have the same disclosures, so that they count as one class,
    known by the number of documents, an exclusive or and a sum of their hashes: a list of a
    thousand addresses isn't multiplied by the words of its document.
    """
    each = held.select("id", "h", F.explode("entities").alias("entity"))
    doc = F.xxhash64("h", F.coalesce(F.xxhash64("id"), F.lit(0)))
    known = each.groupBy("entity").agg(F.count(F.lit(1)).alias("ne"), F.bit_xor(doc).alias("x"), F.sum(doc.bitwiseAND(F.lit(0xFFFFFFFF))).alias("y"))
    known, _ = materialize(known, "pii-entities")
    most = known.agg(F.max("ne")).first()[0] or 0
    classes, _ = materialize(each.join(known, "entity").select("id", "h", "ne", "x", "y").distinct(), "pii-classes")
    return classes, most


def disclosures(docs: DataFrame, text_col: str, held: DataFrame, generalise: float = GENERALISE, min_term: int = MIN_TERM) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """((id, h, ne, x, y, term, nt), (ne, x, y, term, nt, strength), beginnings, documents): terms that may be strong in the documents that hold
    entities, and the pairs of entity class and term of at least ``generalise``, co-occurrence being by whole document.

    A strength of g needs n(t) <= n(e)^g N^(1-g), as n(t, e) is n(e) at most: commoner terms drop out unpaired.
    """
    total = docs.count()
    classes, most = _classes(held)
    bound = F.lit(float(total)) ** (1 - generalise) * F.col("ne").cast("double") ** generalise * (1 + 1e-9)
    counts = docs.select(text_of(text_col).alias("__t")).select(F.explode(F.expr(_words("__t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    counts, _ = materialize(counts.where(F.col("nt") >= min_term), "pii-words")
    rare = counts.withColumn("ne", F.lit(most)).where(F.col("nt") <= bound).select("term", "nt")
    words = held.select("id", "h", F.explode("words").alias("term")).join(rare, "term").withColumnsRenamed({"id": "wid", "h": "wh"})
    pairs = classes.join(words, (F.col("h") == F.col("wh")) & F.col("id").eqNullSafe(F.col("wid"))).where(F.col("nt") <= bound)
    pairs, _ = materialize(pairs.select("id", "h", "ne", "x", "y", "term", "nt"), "pii-pairs")
    n = F.lit(float(total))
    strength = F.try_divide(F.ln(n * F.col("nte") / (F.col("nt").cast("double") * F.col("ne"))), F.ln(n / F.col("ne")))
    strong = pairs.groupBy("ne", "x", "y", "term", "nt").agg(F.count(F.lit(1)).alias("nte")).withColumn("strength", strength)
    strong, _ = materialize(strong.where(F.col("strength") >= generalise).drop("nte"), "pii-strong")
    return pairs, strong, _beginnings(counts, strong), total


def _beginnings(counts: DataFrame, strong: DataFrame) -> DataFrame:
    """(term, begins): the beginnings of each strong term, longest first, as structs of p and n, the documents that some one word with that beginning is in."""
    cut = lambda c: F.explode(F.expr(f"transform(sequence(1, greatest(length({c}) - 1, 1)), k -> left({c}, k))")).alias("p")
    own = strong.select("term").distinct().where("length(term) > 1").select("term", cut("term"))
    own, _ = materialize(own, "pii-beginnings")
    # first the maxima, with map-side combine, as short beginnings are those of very many words
    known = counts.where("length(term) > 1").select("nt", cut("term")).groupBy("p").agg(F.max("nt").alias("n")).join(own.select("p").distinct(), "p", "left_semi")
    known, _ = materialize(known, "pii-known")
    found = own.join(known, "p").groupBy("term").agg(F.expr("array_sort(collect_list(struct(-length(p) AS k, p, n)))").alias("begins"))  # as many as the word has letters
    found, _ = materialize(found, "pii-generalised")
    return found


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, min_term: int = MIN_TERM) -> DataFrame:
    """Spans of every row: (id_col, text_col, email, ip, card, phone, terms).

    The first four are arrays of (s, e, v); terms holds (s, e, v, act, to), act being 'remove' or
    'generalise', to what stands for the term then ('' for removed ones): every occurrence of a strong term in each document that holds the entity, however
    far from it. Offsets are code points, ends exclusive. Null texts count as empty; null and
    repeated ids, and repeated rows, are returned as they come (a row counts as holding an entity
    once for each distinct pair of id and text). Other columns aren't looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), F.xxhash64(F.lit(1), text_of(text_col)).alias("h"))
    # texts without any sign of an entity have no spans, and aren't shuffled
    signs = " OR ".join(f"({need.format(t='__text')})" for need in _NEEDS.values())
    rows = rows.withColumn("__text", text_of("raw"))
    base = base_spans(rows.where(signs).drop("__text"), "raw")
    some = base.where(" OR ".join(f"size(__{k}) > 0" for k in KINDS))
    entities = "array_distinct(concat(" + ", ".join(f"transform(__{k}, x -> {_entity(k)})" for k in KINDS) + "))"
    held = some.select("id", "h", F.expr(entities).alias("entities"), F.expr(_words("__text")).alias("words"))
    held, _ = materialize(held.dropDuplicates(["id", "h"]), "pii-held")
    pairs, strong, begins, total = disclosures(docs, text_col, held, generalise, min_term)
    # a hot pair is dealt out over lanes of documents; a strong one has n(t) near n(t, e), so that lanes are few
    lanes = F.ceil(F.col("nt") / _LANE).cast("int")
    left = pairs.withColumn("lane", F.pmod(F.xxhash64("h", "id"), lanes).cast("int"))
    right = strong.withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1)))
    hits = left.join(right, ["ne", "x", "y", "term", "nt", "lane"]).groupBy("id", "h", "term").agg(F.max("strength").alias("strength"), F.max("ne").alias("ne"))
    hits = hits.join(begins, "term", "left")
    bound = f"pow({float(total)!r}D, {1 - generalise!r}D) * pow(ne, {generalise!r}D) * {1 + 1e-9!r}D"
    to = F.when(F.col("strength") < remove, F.expr(f"get(filter(begins, b -> b.n > {bound}), 0).p || '*'"))
    act = F.when(to.isNull(), "remove").otherwise("generalise")
    found = hits.groupBy("id", "h").agg(F.collect_list(F.struct(F.col("term").alias("v"), act.alias("act"), F.coalesce(to, F.lit("")).alias("to"))).alias("own")).withColumn("n", F.ceil(F.sqrt(F.size("own"))))
    # buckets by hash, so that a long text with many strong terms is not searched by their product
    found = found.select(F.col("id").alias("tid"), F.col("h").alias("th"), "n", F.expr("transform(sequence(0, n - 1), b -> filter(own, t -> pmod(xxhash64(t.v), n) = b))").alias("own"))
    found, _ = materialize(found, "pii-terms")
    out = base.join(found, (F.col("h") == F.col("th")) & F.col("id").eqNullSafe(F.col("tid")), "left")
    marked = f"transform({_located('t', _TERM)}, w -> transform(array(lower(w.v)), v -> struct(w.s AS s, w.e AS e, v AS v, get(filter(get(own, cast(pmod(xxhash64(v), n) AS int)), o -> o.v = v), 0) AS o))[0])"
    terms = f"CASE WHEN own IS NOT NULL THEN transform(filter(transform(array({_masked('__text')}), t -> {marked})[0], w -> w.o IS NOT NULL), w -> struct(w.s AS s, w.e AS e, w.v AS v, w.o.act AS act, w.o.to AS to)) ELSE cast(array() AS array<struct<s: int, e: int, v: string, act: string, to: string>>) END"
    out = out.select("id", "raw", *[F.col(f"__{k}").alias(k) for k in KINDS], F.expr(terms).alias("terms"))
    none = rows.where(f"NOT ({signs})").select("id", "raw", *[F.expr(f"cast(array() AS {out.schema[k].dataType.simpleString()})").alias(k) for k in (*KINDS, "terms")])
    return out.unionByName(none).withColumnsRenamed({"id": id_col, "raw": text_col})


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with base spans as [KIND], removed terms gone, and generalised ones as the beginning that stands for them and '*'.

    Where spans overlap, the one that starts first is replaced, the longer of two.
    """
    found = find_private(docs, id_col, text_col)
    every = "concat(" + ", ".join(f"transform({k}, x -> struct(x.s AS s, -x.e AS ne, '[{k.upper()}]' AS v))" for k in KINDS) + ", transform(terms, x -> struct(x.s AS s, -x.e AS ne, x.to AS v)))"
    found = found.withColumn("__t", text_of(text_col)).withColumn("__all", F.expr(f"array_sort({every})"))
    fold = "aggregate(__all, struct(0 AS p, cast(array() AS array<string>) AS o), (a, x) -> CASE WHEN x.s < a.p THEN a ELSE struct(-x.ne AS p, concat(a.o, array(substring(__t, a.p + 1, x.s - a.p), x.v)) AS o) END, a -> concat(array_join(a.o, ''), substring(__t, a.p + 1)))"
    return found.select(F.col(id_col), F.expr(fold).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans of :func:`find_private`."""

    def joined(k: str, col: str | None = None) -> Column:
        return F.expr(f"transform({col or k}, x -> concat('{k}:', x.s, ':', x.e))")

    base = F.concat(*[joined(k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, joined("term", "terms")), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"), F.size(F.filter("terms", lambda t: t["act"] == "generalise")).cast("long").alias("n_generalised"))
