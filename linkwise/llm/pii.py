"""Personal data by base patterns and bootstrapped contextual extraction.

Base: e-mail, IP, card and phone patterns, leftmost and non-overlapping per kind, with their
checks (IP parts, Luhn, digit counts); failing matches are dropped without a retry.

Bootstrapping: base entities are the seeds. Every occurrence of a seed, and of any other
identifier-like token (a run of non-blanks with a digit or @ in it), has two lexical
patterns: the nearest word on its left and the one on its right. Patterns and instances
form a bipartite graph that is scored in rounds:

* a pattern with F known of N distinct instances is trusted if F >= ``MIN_KNOWN`` and
  F / N >= ``MIN_PRECISION``;
* an unknown instance becomes known if at least ``MIN_PATTERNS`` trusted patterns extract it and
  1 - product(1 - F / N) over them reaches ``MIN_CONFIDENCE``;

until a round adds nothing. Occurrences of the instances found this way, outside
base spans, are spans of kind ``context``.

Everything is DataFrame functions. The base patterns are rewritten so that they run in
linear time on any text and match the same: a run may only be entered at its start (or where the last match
ended), and repeated groups are possessive where giving back could never help.
Offsets are running sums of match and gap lengths over the exploded matches, so no row
gathers more than its own matches. Texts are scanned whole.

Null and empty texts have no spans. Rows are told apart by id and text, so repeated rows
get equal results each; null ids are kept. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwise.llm.common import NULL_ID, id_text
from linkwise.session import materialize

MIN_KNOWN = 5
MIN_PRECISION = 0.5
MIN_PATTERNS = 2
MIN_CONFIDENCE = 0.9
#: Characters of a gap in which the neighbouring word is looked for.
REACH = 60

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
#: What a text must hold for the pattern to match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9@]"}
EDGES = ".,;:!?()[]{}<>\"'"
ITEM = "array<struct<kind:string,at:int,gap:int,found:string,before:string,after:string>>"


def _matches(text: Column, kind: str) -> Column:
    """Matches of one pattern in order, each with the gap before it and the text around it."""
    pattern = PATTERNS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def item(gap, i):
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(gap).alias("gap"), F.lit("").alias("found"),
                        F.right(gap, F.lit(REACH)).alias("before"), F.left(gap, F.lit(REACH)).alias("after"))

    pieces = F.transform(gaps, item)
    paired = F.zip_with(
        F.zip_with(pieces, found, lambda p, m: F.struct(
            p["kind"].alias("kind"), p["at"].alias("at"), p["gap"].alias("gap"), m.alias("found"),
            p["before"].alias("before"))),
        F.slice(F.transform(pieces, lambda p: p["after"]), 2, F.size(pieces)),
        lambda p, after: F.struct(*[p[c].alias(c) for c in ("kind", "at", "gap", "found", "before")],
                                  after.alias("after")))
    kept = F.filter(paired, lambda p: p["found"].isNotNull())
    return F.when(text.rlike(NEEDS[kind]), kept).otherwise(F.array().cast(ITEM))


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid() -> Column:
    """The check of each base kind; tokens always pass."""
    found, kind = F.col("found"), F.col("kind")
    parts = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card, phone = F.translate(found, " -", ""), F.length(F.regexp_replace(found, "[^0-9]", ""))
    return (F.when(kind == "ip", ip)
            .when(kind == "card", F.when(F.length(card).between(16, 19), _luhn(card)).otherwise(False))
            .when(kind == "phone", phone.between(8, 15)).otherwise(True))


def _word(side: Column, last: bool) -> Column:
    pattern = r"(\p{L}[\p{L}\p{M}]*+)[^\p{L}]*$" if last else r"^[^\p{L}]*(\p{L}[\p{L}\p{M}]*+)"
    return F.lower(F.regexp_extract(side, pattern, 1))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, items): one row per input row; ``version`` tells texts of one id apart."""
    source, text = id_text(docs, id_col, text_col), F.col("text")
    items = F.concat(*[_matches(text, k) for k in PATTERNS])
    return source.select("id", F.xxhash64("text").alias("version"),
                         F.when(text.rlike("[0-9@]"), items).otherwise(F.array().cast(ITEM)).alias("items"))


def occurrences(scan: DataFrame) -> DataFrame:
    """(id, version, kind, start, end, instance, left, right): valid base spans, and tokens outside them."""
    rows = scan.where(F.size("items") > 0).dropDuplicates(["id", "version"]).select(
        "id", "version", F.explode("items").alias("m")).select("id", "version", "m.*")
    size = F.col("gap") + F.length("found")
    order = W.partitionBy("id", "version", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(size.cast("long")).over(order)).where(_valid())
    edges, token = F.lit(EDGES), F.col("kind") == "token"
    lead = F.length("found") - F.length(F.ltrim("found", edges))
    core = F.when(token, F.rtrim(F.ltrim("found", edges), edges)).otherwise(F.col("found"))
    start = F.col("end") - F.length("found") + F.when(token, lead).otherwise(0)
    spans = placed.select(
        "id", "version", "kind", start.alias("start"), (start + F.length(core)).alias("end"),
        F.md5(F.lower(core).cast("binary")).alias("instance"), _word(F.col("before"), True).alias("left"),
        _word(F.col("after"), False).alias("right")).where(F.col("end") > F.col("start"))
    # tokens that overlap a base span are that entity (or a part of it), not another one
    base = F.col("kind") != "token"
    row = W.partitionBy("id", "version")
    reached = F.max(F.when(base, F.col("end"))).over(
        row.orderBy("start", base.desc()).rowsBetween(W.unboundedPreceding, -1))
    # a running minimum from the right: a frame that ends at the partition's end would be worked out anew for each row
    coming = F.min(F.when(base, F.col("start"))).over(
        row.orderBy(F.desc("start"), base.asc()).rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("reached", reached).withColumn("coming", coming)
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (
        F.coalesce("coming", F.col("end")) >= F.col("end"))
    return marked.where(base | free).drop("reached", "coming")


def bootstrap(found: DataFrame) -> DataFrame:
    """(instance): what trusted contexts show to be identifiers beyond the seeds."""
    graph = found.select("instance", (F.col("kind") != "token").alias("known"), F.explode(F.array(
        F.when(F.col("left") != "", F.concat(F.lit("L:"), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("R:"), "right")))).alias("pattern")).where("pattern is not null")
    graph = graph.groupBy("instance", "pattern").agg(F.max("known").alias("known"))
    # an instance known from any of its occurrences is known in all of them
    seeds = found.where("kind <> 'token'").select("instance").distinct().withColumn("seed", F.lit(True))
    graph = materialize(graph.join(seeds, "instance", "left").select(
        "instance", "pattern", F.coalesce("seed", F.lit(False)).alias("known")), "pii-graph")
    new = None
    while True:
        stats = graph.groupBy("pattern").agg(F.sum(F.col("known").cast("long")).alias("f"), F.count(F.lit(1)).alias("n"))
        trusted = stats.where((F.col("f") >= MIN_KNOWN) & (F.col("f") >= MIN_PRECISION * F.col("n")))
        doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.col("f") / F.col("n")))
        scored = graph.where("not known").join(trusted, "pattern").groupBy("instance").agg(
            F.sum(doubt).alias("doubt"), F.count(F.lit(1)).alias("patterns"))
        sure = scored.where((F.col("patterns") >= MIN_PATTERNS) & (1 - F.exp("doubt") >= MIN_CONFIDENCE))
        added = materialize(sure.select("instance"), "pii-added")
        if not added.limit(1).count():
            return new if new is not None else added
        new = added if new is None else new.unionByName(added)
        graph = materialize(graph.join(added.withColumn("add", F.lit(True)), "instance", "left").select(
            "instance", "pattern", (F.col("known") | F.coalesce("add", F.lit(False))).alias("known")), "pii-graph")


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one (id, version) per input row; spans (id, version, kind, start, end) per distinct id and text)."""
    scan = materialize(scanned(docs, id_col, text_col), "pii-scan")
    found = materialize(occurrences(scan), "pii-occurrences")
    extra = found.where("kind = 'token'").join(bootstrap(found), "instance", "left_semi")
    columns = ("id", "version", "kind", "start", "end")
    spans = found.where("kind <> 'token'").select(*columns).unionByName(
        extra.withColumn("kind", F.lit(CONTEXT)).select(*columns))
    return scan.select("id", "version"), spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _only(kind: str):
    return lambda x: F.when(x == F.lit(kind), x)


def spans_by_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> ..., base_sha256, spans): one row per input row."""
    rows, spans = all_spans(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)]), F.col("kind"))
    listed = spans.groupBy("id", "version").agg(F.array_sort(F.collect_set(
        F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("list"))
    out = rows.join(listed, ["id", "version"], "left").withColumn(
        "list", F.coalesce("list", F.array().cast("array<struct<rank:long,start:long,end:long,kind:string>>")))
    kinds = F.transform("list", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{k}")
              for k in (*KINDS, CONTEXT)]
    base = F.filter("list", lambda s: s["kind"] != CONTEXT)
    return out.select("id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                      _joined(F.col("list")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows with every span replaced by its kind in brackets; overlapping spans count as
    one of the first kind. ``length_col`` is set to the new length. Rows without spans stay as they are."""
    _, spans = all_spans(docs, id_col, text_col)
    order = W.partitionBy("id", "version").orderBy("start", F.desc("end"))
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = spans.distinct().withColumn("opens", (F.coalesce(reached, F.lit(0)) <= F.col("start")).cast("int"))
    runs = first.withColumn("run", F.sum("opens").over(order)).groupBy("id", "version", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "start").alias("kind"))
    listed = runs.groupBy("id", "version").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__pii_spans")).select(
        F.col("id").alias("__pii_id"), F.col("version").alias("__pii_version"), "__pii_spans")
    keyed = docs.withColumns({"__pii_id": F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)),
                              "__pii_version": F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))})
    joined, text = keyed.join(listed, ["__pii_id", "__pii_version"], "left"), F.col(text_col)
    ends = F.transform(F.slice("__pii_spans", 1, F.size("__pii_spans") - 1), lambda s: s["end"])
    begins = F.concat(F.array(F.lit(0).cast("long")), ends)
    parts = F.zip_with(begins, F.col("__pii_spans"), lambda at, s: F.concat(
        F.substring(text, at.cast("int") + 1, (s["start"] - at).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(text, (F.element_at("__pii_spans", -1)["end"] + 1).cast("int"), F.length(text))
    out = joined.withColumn(text_col, F.when(F.col("__pii_spans").isNotNull(), F.concat(
        F.array_join(parts, ""), tail)).otherwise(text))
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out.select(*docs.columns)
