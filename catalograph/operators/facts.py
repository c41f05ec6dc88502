"""Fact maintenance: each operator takes the quad table and a request table, and says what changes.

A request is all or nothing: its rows are judged first, and a request with one bad row is left out whole. The answer
is a `Change`; applying it and writing the next snapshot is the commit, so a job that dies changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import (bare_id, iri_from_bracket, is_json_string, is_zoned_date, json_text, stripped)
from catalograph.operators import patterns as P
from catalograph.session import cut_lineage


@dataclass(frozen=True)
class Change:
    """`removed` holds whole quads or just their leading keys (store, s[, p]); `added` holds new quads.

    `preds` names the only predicates a change concerns, where that is known: the rest of the table then passes
    through `apply` unjoined, partition by partition. `where` is a condition on quads that go by what they say: they are filtered, not joined.
    """
    added: DataFrame | None
    removed: DataFrame | None
    report: DataFrame
    preds: tuple[str, ...] | None = None
    where: Column | None = None

    def held(self) -> Change:
        """The same change with its quads written out: it is read several times in a commit, and its source is about to be replaced."""
        cut = lambda d: None if d is None else cut_lineage(d)
        return replace(self, added=cut(self.added), removed=cut(self.removed))

    def touches(self, q: DataFrame) -> list[str]:
        """The predicates of the quads that come or go."""
        found = [] if self.added is None else [self.added.select("p")]
        if self.removed is not None:
            by_name = self.removed.select("p") if "p" in self.removed.columns else q.join(
                self.removed, P.shared_vars(self.removed, q), "left_semi").select("p")
            found.append(by_name)
        if self.where is not None:
            found.append(q.filter(F.coalesce(self.where, F.lit(False))).select("p"))
        return sorted({r.p for d in found for r in d.distinct().collect()})  # predicates are the data model's

    def within(self, preds: list[str]) -> Change:
        return replace(self, preds=tuple(preds))

    def apply(self, q: DataFrame) -> DataFrame:
        here, rest = q, None
        if self.preds is not None:
            here, rest = q.filter(F.col("p").isin(*self.preds)), q.filter(~F.col("p").isin(*self.preds))
        if self.where is not None:
            here = here.filter(~F.coalesce(self.where, F.lit(False)))
        out = here if self.removed is None else P.delete_where(here, self.removed)
        if self.added is not None:
            out = out.unionByName(P.fresh_quads(out, self.added))
        return out if rest is None else rest.unionByName(out)


def quad(store: Column, s: Column, p: Column | str, o: Column, kind: str = "literal", dt: Column | str | None = None) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return [store.alias("store"), s.alias("s"), as_col(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
            as_col(dt).alias("dt"), F.lit(N.GRAPH).alias("g")]


def classes(q: DataFrame, *names: str) -> DataFrame:
    """(store, s, class) of typed nodes."""
    t = q.filter((F.col("p") == N.RDF_TYPE) & F.col("o").isin(*[N.v(n) for n in names]))
    return t.select("store", "s", F.substring_index("o", "/", -1).alias("class")).dropDuplicates()


# ── literals ────────────────────────────────────────────────────────────────────────────────────────────────

NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def with_literal(df: DataFrame, range_: Column, value: str = "value") -> DataFrame:
    """Add `range`, `text` and `datatype` of a JSON value for its declared range; text is NULL when it does not fit.

    The value is parsed once into a column of its own, which the checks then share.
    """
    raw = F.get_json_object(F.concat(F.lit('{"v":'), F.col(value), F.lit("}")), "$.v")
    df = df.withColumns({"range": range_, "__raw": raw, "__str": is_json_string(F.col(value))}).withColumn("__text", stripped("__raw"))
    text, is_text, r = F.col("__text"), F.col("__str"), F.col("range")
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    bounded = F.lit(None).cast("bigint")
    for name, (lo, hi) in N.BOUNDED_INTEGERS.items():
        bounded = F.when((r == name) & whole.between(lo, hi), whole).otherwise(bounded)
    out = (F.when(r == "integer", whole.cast("string"))
           .when(r == "boolean", F.when(text.isin("true", "false"), text))
           .when(r == "decimal", F.when(text.rlike(NUMBER), text))
           .when(r == "dateTime", F.when(is_text & is_zoned_date(text), text))
           .when(r == "string", F.when(is_text, F.col("__raw")))
           .otherwise(bounded.cast("string")))
    kind = F.when(r.isin("integer", "boolean", "decimal", "dateTime"), r).when(r != "string", "integer")
    return df.withColumns({"text": out, "datatype": F.concat(F.lit(N.XSD), kind)}).drop("__raw", "__str", "__text")


def _range_of(key: Column, fields: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), key)


def link_targets(value: Column) -> Column:
    """A JSON string or list of strings as an array of references."""
    return F.when(stripped(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(json_text(value)))


def judge_links(q: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows(…, store, s, target)` with `node` and the reason a link is refused, if it is.

    A target is a set, image or video of the same store, not the media itself, and a set takes its own media kind
    only. One lookup of typed nodes serves all checks.
    """
    node = F.when(F.col("target").rlike("^https?://"), stripped("target")).otherwise(iri_from_bracket(F.col("target")))
    rows = rows.withColumn("node", node)
    known = classes(q, "Image", "Video", "Media", *N.SET_MEMBER)
    rows = rows.join(known.select("store", F.col("s").alias("node"), F.col("class").alias("target_class")), ["store", "node"], "left")
    member = F.try_element_at(F.create_map(*[F.lit(x) for kv in N.SET_MEMBER.items() for x in kv]), F.col("target_class"))
    reason = (F.when(F.col("node").isNull(), "not a reference")
              .when(~F.col("node").startswith(N.MEDIA_NS), "outside this catalogue")
              .when(F.col("node") == F.col("s"), "the media itself")
              .when(F.col("target_class").isNull(), "no such thing in this store")
              .when(member.isNotNull() & (member != F.col("class")), "wrong kind of set"))
    return rows.withColumn("link_reason", reason)


def set_fields(q: DataFrame, edits: DataFrame, fields: dict[str, str] | None = None) -> Change:
    """Set: every key must be settable and every value fit its range, or the request is refused whole; then the old
    values of each key are replaced. `relatedToId` adds links instead and leaves the present ones.

    `edits(request, seq, store, s, key, value)`: `value` is JSON; the greatest `seq` of a key is the one that stays.
    """
    fields = fields or N.settable()
    media = classes(q, "Image", "Video", "Media")
    rows = edits.join(media, ["store", "s"], "left")
    is_link = F.col("key") == "relatedToId"
    plain = with_literal(rows.filter(~is_link), _range_of(F.col("key"), fields)).select(
        "request", "seq", "store", "s", "key", F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.col("datatype").alias("dt"),
        F.when(F.col("class").isNull(), "id not found").when(F.col("range").isNull(), "not settable")
        .when(F.col("text").isNull(), "invalid value").alias("reason"))
    links = judge_links(q, rows.filter(is_link).select("request", "seq", "store", "s", "class", "key", F.explode(link_targets(F.col("value"))).alias("target")))
    links = links.select("request", "seq", "store", "s", "key", F.col("node").alias("o"), F.lit("iri").alias("o_kind"),
                         F.lit(None).cast("string").alias("dt"),
                         F.when(F.col("class").isNull(), "id not found").otherwise(F.col("link_reason")).alias("reason"))
    judged = cut_lineage(plain.unionByName(links))  # feeds the report, the values and the edges
    report = judged.groupBy("request").agg(F.min("reason").alias("reason"), F.count("*").alias("rows")).withColumn(
        "status", F.when(F.col("reason").isNull(), "done").otherwise("refused"))
    good = judged.join(report.filter("status = 'done'").select("request"), "request", "left_semi")
    last = good.filter(~is_link).groupBy("store", "s", "key").agg(F.max(F.struct("seq", "request", "o", "o_kind", "dt")).alias("x"))
    values = last.select("store", "s", F.concat(F.lit(N.VOCAB), "key").alias("p"), "x.o", "x.o_kind", "x.dt")
    edges = good.filter(is_link).select("store", "s", F.lit(N.v("relatedToId")).alias("p"), "o", "o_kind", "dt").dropDuplicates()
    added = values.unionByName(edges).withColumn("g", F.lit(N.GRAPH)).select(*N.QUAD_COLS)
    preds = tuple(N.v(f) for f in [*fields, "relatedToId"])
    return Change(added, values.select("store", "s", "p"), report, preds)


def add_links(q: DataFrame, edits: DataFrame) -> Change:
    """relatedToId only: `edits(request, seq, store, s, value)`; a link already there is no change."""
    c = set_fields(q, edits.withColumn("key", F.lit("relatedToId")))
    return Change(P.fresh_quads(q.filter(F.col("p") == N.v("relatedToId")), c.added), None, c.report, (N.v("relatedToId"),))


def unset_fields(q: DataFrame, edits: DataFrame, fields: dict[str, str] | None = None) -> Change:
    """Unset: all values of a key go. A link comes off by `relatedToId=<…>`; bare `relatedToId` is refused, and so
    is a name nobody may set. A key without a value is fine. `edits(request, store, s, field)`."""
    fields = fields or N.settable()
    rows = edits.join(classes(q, "Image", "Video", "Media"), ["store", "s"], "left")
    target = F.regexp_extract("field", "^relatedToId=(.*)$", 1)
    node = F.when(target.rlike("^https?://"), target).otherwise(iri_from_bracket(target))
    is_link = F.col("field").startswith("relatedToId=")
    reason = (F.when(F.col("class").isNull(), "id not found")
              .when(is_link, F.when(node.isNull(), "not a reference"))
              .when(F.col("field") == "relatedToId", "say which link")
              .when(_range_of(F.col("field"), fields).isNull(), "not settable"))
    judged = rows.withColumn("reason", reason).withColumn("node", node).withColumn("is_link", is_link)
    report = judged.groupBy("request").agg(F.min("reason").alias("reason"), F.count("*").alias("rows")).withColumn(
        "status", F.when(F.col("reason").isNull(), "done").otherwise("refused"))
    good = judged.join(report.filter("status = 'done'").select("request"), "request", "left_semi")
    keys = good.filter("NOT is_link").select("store", "s", F.concat(F.lit(N.VOCAB), "field").alias("p"))
    whole = q.filter(F.col("p").isin(*[N.v(f) for f in fields])).join(keys.dropDuplicates(), ["store", "s", "p"], "left_semi")
    links = good.filter("is_link").select("store", "s", F.lit(N.v("relatedToId")).alias("p"), F.col("node").alias("o"))
    edges = q.filter(F.col("p") == N.v("relatedToId")).join(links.dropDuplicates(), ["store", "s", "p", "o"], "left_semi")
    preds = tuple(N.v(f) for f in [*fields, "relatedToId"])
    return Change(None, whole.select(*N.QUAD_COLS).unionByName(edges.select(*N.QUAD_COLS)), report, preds)


def set_perception(q: DataFrame, parsed: DataFrame) -> Change:
    """Replace every perception field of a media by a parsed caption answer.

    Both captions are written even when empty. `parsed(store, s, short_caption, long_caption, prompt_path, objects,
    scene array<struct<k,v>>)`.
    """
    one = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("v"))
    values = F.concat(
        F.array(one("shortCaption", F.coalesce("short_caption", F.lit(""))), one("longCaption", F.coalesce("long_caption", F.lit("")))),
        F.when(stripped(F.coalesce("prompt_path", F.lit(""))) != "", F.array(one("modelPromptPath", F.col("prompt_path"))))
        .otherwise(F.array().cast("array<struct<k:string,v:string>>")),
        F.transform("objects", lambda x: F.struct(F.lit("sceneObjects").alias("k"), x.alias("v"))), F.col("scene"))
    rows = parsed.select("store", "s", F.explode(values).alias("x"))
    added = rows.select(*quad(F.col("store"), F.col("s"), F.concat(F.lit(N.VOCAB), F.col("x.k")), F.col("x.v"))).dropDuplicates()
    preds = [N.v(f) for f in N.PERCEPTION_FIELDS]
    return Change(added, parsed.select("store", "s").dropDuplicates(), added.groupBy("store", "s").agg(F.count("*").alias("facts")), tuple(preds))


def add_statements(q: DataFrame, statements: DataFrame) -> Change:
    """A producer's later statements: only new ones land. `statements` are quads with `media` (whose file they
    belong to) and `block` (the description they stand in)."""
    stated = statements.select("media", "block", *N.QUAD_COLS).dropDuplicates(["media", *N.QUAD_COLS])
    new = P.fresh_quads(q, stated)
    mark = new.withColumn("dt_", F.coalesce("dt", F.lit(""))).select("store", "s", "p", "o", "o_kind", "dt_", "g", F.lit(1).alias("new"))
    counted = stated.withColumn("dt_", F.coalesce("dt", F.lit(""))).join(mark, ["store", "s", "p", "o", "o_kind", "dt_", "g"], "left")
    blocks = statements.groupBy("store", "media").agg(F.count_distinct("block").alias("descriptions"))
    report = counted.groupBy("store", "media").agg(F.count("*").alias("statements"), F.count("new").alias("inserted"))
    return Change(new, None, report.join(blocks, ["store", "media"]))


def describe_facts(q: DataFrame, facts: DataFrame, prefixes: dict[str, str] = N.PREFIXES) -> Change:
    """Append caller facts `(store, s, name, values)`. A name that does not resolve fails the whole call."""
    rows = P.resolve_names(facts, "name", prefixes, "p").select("store", "s", "p", F.explode("values").alias("o"))
    new = P.fresh_quads(q, rows.select(*quad(F.col("store"), F.col("s"), F.col("p"), F.col("o"))))
    return Change(new, None, new.groupBy("store", "s").agg(F.count("*").alias("facts")))


def touch(q: DataFrame, changed: DataFrame, now: str) -> Change:
    """Exactly one updatedDate on every changed subject `(store, s)`."""
    keys = changed.select("store", "s").dropDuplicates()
    added = keys.select(*quad(F.col("store"), F.col("s"), N.v("updatedDate"), F.lit(now)))
    return Change(added, keys, keys, (N.v("updatedDate"),))


def mark_complete(q: DataFrame, ids: DataFrame, now: str) -> Change:
    """The completion date, once: media that carry one are left alone."""
    keys = ids.select("store", "s").dropDuplicates().join(classes(q, "Image", "Video", "Media").select("store", "s"), ["store", "s"], "left_semi")
    new = keys.join(q.filter(F.col("p") == N.v("enrichmentCompleteDate")).select("store", "s"), ["store", "s"], "left_anti")
    return Change(new.select(*quad(F.col("store"), F.col("s"), N.v("enrichmentCompleteDate"), F.lit(now))), None, new,
                  (N.v("enrichmentCompleteDate"),))


# ── removal ─────────────────────────────────────────────────────────────────────────────────────────────────

def owned_nodes(q: DataFrame, media: DataFrame, links: list[str]) -> DataFrame:
    """(store, media, link, s, role): the nodes that exist only because a media does — its thumbnail, its stage
    references and the records these hold. Nodes it merely points at are not among them."""
    keys = media.select("store", F.col("s").alias("media")).dropDuplicates()
    refs = q.filter(F.col("p").isin(*[N.v(x) for x in links]) & (F.col("o_kind") == "iri")).select(
        "store", F.col("s").alias("media"), F.substring_index("p", "/", -1).alias("link"), F.col("o").alias("s"))
    refs = refs.join(keys, ["store", "media"], "left_semi")
    items = q.filter(F.col("p") == N.v("item")).select("store", "s", F.col("o").alias("item")).join(
        refs, ["store", "s"]).select("store", "media", "link", F.col("item").alias("s"))
    return refs.withColumn("role", F.lit("ref")).unionByName(items.withColumn("role", F.lit("item")))


def owned_files(q: DataFrame, owned: DataFrame) -> DataFrame:
    """(store, media, path): every file the owned nodes name."""
    preds = [N.v(f) for f in N.REF_FILE_FIELDS + N.ITEM_FILE_FIELDS]
    named = q.filter(F.col("p").isin(*preds)).select("store", "s", "p", F.col("o").alias("path"))
    fits = (F.col("role") == "ref") == F.col("p").isin(*[N.v(f) for f in N.REF_FILE_FIELDS])
    return named.join(owned, ["store", "s"]).filter(fits).select("store", "media", "path").dropDuplicates()


def vector_keys(owned: DataFrame) -> DataFrame:
    """Keys to take out of the indexes: the image for embeddings, the record for faces."""
    image = owned.filter("link = 'vectorData' AND role = 'ref'").select("store", bare_id(F.col("media")).alias("key_id"))
    face = owned.filter("link = 'faceData' AND role = 'item'").select("store", bare_id(F.col("s")).alias("key_id"))
    return image.unionByName(face).dropDuplicates()


def forget(q: DataFrame, media: DataFrame, link: str) -> tuple[Change, DataFrame]:
    """(change, vector keys): one stage's result of each media goes — reference, records, named files, completion
    date. A stage that never ran is a zero report; an unknown stage is refused."""
    if link not in N.LINKS:
        raise ValueError(f"no stage writes {link}; known: {', '.join(N.LINKS)}")
    owned = cut_lineage(owned_nodes(q, media, [link]))  # small, and every branch starts from it
    hit = owned.select("store", F.col("media")).dropDuplicates()
    nodes = q.join(owned.select("store", "s", "media").dropDuplicates(["store", "s"]), ["store", "s"])
    mine = q.filter(F.col("p").isin(N.v(link), N.v("enrichmentCompleteDate"))).join(
        hit.withColumnRenamed("media", "s"), ["store", "s"], "left_semi").withColumn("media", F.col("s"))
    gone = nodes.select(*N.QUAD_COLS, "media").unionByName(mine.select(*N.QUAD_COLS, "media"))
    facts = gone.groupBy("store", "media").agg(F.count("*").alias("facts_removed"))
    files = owned_files(q, owned).groupBy("store", "media").agg(F.count("*").alias("files_removed"))
    report = (media.select("store", F.col("s").alias("media")).dropDuplicates()
              .join(facts, ["store", "media"], "left").join(files, ["store", "media"], "left")
              .fillna(0, ["facts_removed", "files_removed"]))
    return Change(None, gone.select(*N.QUAD_COLS), report), vector_keys(owned)


def delete_media(q: DataFrame, media: DataFrame) -> tuple[Change, DataFrame]:
    """(change, vector keys): media and everything they own; what they merely point at stays."""
    owned = cut_lineage(owned_nodes(q, media, N.OWNED_LINKS))
    targets = owned.select("store", "s", "media").unionByName(media.select("store", "s", F.col("s").alias("media"))).dropDuplicates(["store", "s"])
    gone = q.join(targets, ["store", "s"])
    own_file = q.filter(F.col("p") == N.v("mediaPath")).select("store", F.col("s").alias("media"), F.col("o").alias("path")).join(
        media.select("store", F.col("s").alias("media")), ["store", "media"], "left_semi")
    files = owned_files(q, owned).unionByName(own_file).dropDuplicates().groupBy("store", "media").agg(F.count("*").alias("files"))
    report = gone.groupBy("store", "media").agg(F.count("*").alias("facts")).join(files, ["store", "media"], "left").fillna(0, ["files"])
    keys = vector_keys(owned).unionByName(media.select("store", bare_id(F.col("s")).alias("key_id"))).dropDuplicates()
    return Change(None, targets.select("store", "s"), report), keys


def wipe(q: DataFrame, link: str = "vectorData") -> Change:
    """Every reference of one stage in every media, with its records. The report counts the images per store."""
    refs = q.filter(F.col("p") == N.v(link))
    owned = owned_nodes(q, refs.select("store", "s"), [link])
    report = refs.groupBy("store").agg(F.count_distinct("s").alias("images"))
    return Change(None, owned.select("store", "s").dropDuplicates(), report, where=F.col("p") == N.v(link))


def unset_everywhere(q: DataFrame, field: str) -> Change:
    """One predicate off every subject; a second run finds none."""
    gone = q.filter(F.col("p") == N.v(field))
    report = gone.groupBy("store").agg(F.count_distinct("s").alias("subjects"), F.count("*").alias("facts"))
    return Change(None, None, report, where=F.col("p") == N.v(field))


def rename_ns(q: DataFrame, old: str, new: str) -> Change:
    """Predicates and IRI objects under one namespace move to another; subjects and literals stay. Facts are
    counted as found, before any fall together."""
    if not old or not new:
        raise ValueError("both namespaces must be given")
    if old == new:
        raise ValueError(f"the two namespaces are the same: {old}")
    hit = F.col("p").startswith(old) | ((F.col("o_kind") == "iri") & F.col("o").startswith(old))
    moved = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(F.col(c))
    was = q.filter(hit)
    now = was.withColumn("p", moved("p")).withColumn("o", F.when(F.col("o_kind") == "iri", moved("o")).otherwise(F.col("o")))
    images = classes(q, "Image").select("store", "s", F.lit(1).alias("image"))
    per = was.groupBy("store", "s").agg(F.count("*").alias("n")).join(images, ["store", "s"], "left")
    report = per.groupBy("store").agg(F.count("image").alias("images"), F.sum("n").alias("facts"))
    return Change(now.select(*N.QUAD_COLS).dropDuplicates(), None, report, where=hit)
