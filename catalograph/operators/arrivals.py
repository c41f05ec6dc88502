"""Arriving files and producer packets to facts.

Each check adds a `reason`; a media with any reason is refused whole and goes to the rejects, the rest become quads.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import (base32_id, date_from_name, iri_from_bracket, is_zoned_date, media_class, media_kind,
                                        media_path, rendition_path, set_from_name, stripped, valid_id)
from catalograph.operators import patterns as P
from catalograph.operators.analytics import png_read
from catalograph.operators.facts import classes
from catalograph.operators.sets import set_quads
from catalograph.session import cut_lineage

THUMB_EDGE = 512
# Brands of still pictures in the video container (avif, avis, heic, heix, heim, mif1, msf1), and picture types that are recognised
# but not decoded, so refused.
STILL_BRANDS = ("61766966", "61766973", "68656963", "68656978", "6865696D", "6D696631", "6D736631")
UNDECODED = ("image/bmp", "image/x-icon", "image/avif")
HELD = 1 << 20  # characters of packets whose statements are held before they are passed on
STATEMENT_SCHEMA = "store string, media string, block int, s string, p string, o string, o_kind string, dt string"


def sniff(content: Column) -> Column:
    """The media type the first bytes say, or NULL."""
    h = F.hex(F.substring(content, 1, 12))
    brand = F.substring(h, 17, 8)
    return (F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg")
            .when(h.startswith("47494638"), "image/gif").when(h.startswith("52494646") & (brand == "57454250"), "image/webp")
            .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff")
            .when(h.startswith("424D"), "image/bmp").when(h.startswith("00000100"), "image/x-icon")
            .when((F.length(content) >= 12) & (F.substring(h, 9, 8) == "66747970"),
                  F.when(brand == "71742020", "video/quicktime").when(brand.isin(*STILL_BRANDS), "image/avif")
                  .otherwise("video/mp4")))


def verify(arrivals: DataFrame) -> DataFrame:
    """Add `media_type` as the bytes say it and the reason a false claim is refused for."""
    seen, claim = sniff(F.col("content")), F.coalesce("claimed", F.lit(""))
    reason = (F.when(seen.isin(*UNDECODED), "not a readable image").when(claim.startswith("image/") & ~F.coalesce(seen.startswith("image/"), F.lit(False)), "not a readable image")
              .when(claim.startswith("video/") & ~F.coalesce(seen.startswith("video/"), F.lit(False)), "not a readable video"))
    return arrivals.withColumn("media_type", F.coalesce(seen, F.nullif(claim, F.lit("")), F.lit("application/octet-stream"))).withColumn("reason", reason)


def mint_ids(arrivals: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Add `id`: letters drawn from the arrival itself (store, batch, path, time), never from its content, so a retried batch
    gets the same ids and the same bytes twice get two. A batch that may bring a path twice tells its files apart by `item`, which then is
    drawn from too. Ids already taken are drawn again until they are free; each look reads no content."""
    seed = F.concat_ws("|", "store", "batch", "path", *[c for c in ("created", "item") if c in arrivals.columns])
    out = arrivals.withColumn("id", base32_id(seed))
    if taken is None:
        return out
    used = cut_lineage(taken.select("store", "id").dropDuplicates())
    draw = 0
    while not out.select("store", "id").join(used, ["store", "id"], "left_semi").isEmpty():
        draw += 1
        out = out.join(used.withColumn("used", F.lit(True)), ["store", "id"], "left").withColumn(
            "id", F.when(F.col("used"), base32_id(F.concat(seed, F.lit(f"|again{draw}")))).otherwise(F.col("id"))).drop("used")
    return out


def _be32(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")


def arrival_rows(arrivals: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Arrivals `(store, batch, path, content, claimed, created[, item])` verified, named and placed: one row each."""
    df = mint_ids(verify(arrivals), taken)
    arrived = F.col("media_type")
    png = arrived == "image/png"
    converted = arrived.startswith("image/") & ~png
    ext_of = F.lit("bin")
    for mime, ext in N.EXTENSION_BY_MIME.items():
        ext_of = F.when(arrived == mime, ext).otherwise(ext_of)
    ihdr = png & (F.length("content") >= 24)
    df = df.withColumn("width", F.when(ihdr, _be32(F.col("content"), 17))).withColumn("height", F.when(ihdr, _be32(F.col("content"), 21)))
    df = df.withColumn("read", png_read(F.col("content"))).withColumn("sha256", F.col("read.sha256"))
    df = df.withColumn("reason", F.coalesce("reason", F.when(png, F.col("read.fault")))).withColumn(
        "render_request", F.when(png, F.nullif(stripped(F.col("read.request")), F.lit(""))))
    df = df.drop("read").withColumn("arrived_ext", ext_of).withColumn("converted", converted)
    df = df.withColumn("media_type", F.when(converted, "image/png").otherwise(arrived))
    df = df.withColumn("class", media_class(F.col("media_type"))).withColumn("kind", media_kind(F.col("media_type")))
    df = df.withColumn("iri", F.concat(F.lit(N.MEDIA_NS), "class", F.lit("/"), "id"))
    ext = F.when(F.col("converted"), "png").otherwise(F.col("arrived_ext"))
    df = df.withColumn("media_path", media_path(F.col("kind"), F.col("created"), F.col("id"), ext))
    original = media_path(F.col("kind"), F.col("created"), F.col("id"), F.col("arrived_ext"), sub="original")
    return df.withColumn("source_file", F.when(F.col("converted"), original).otherwise(F.col("media_path"))).drop("content")


def arrival_quads(rows: DataFrame) -> DataFrame:
    """The structural facts of accepted arrivals. The thumbnail node is declared with the size its rendition has."""
    t = lambda s, p, o, k="literal": F.struct(s.alias("s"), F.lit(N.v(p) if ":" not in p else p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind"))
    iri = F.col("iri")
    thumb = F.when(F.col("width").isNotNull(), F.concat(F.lit(N.MEDIA_NS + "Thumbnail/"), base32_id(F.concat_ws("|", "store", "id", F.lit("thumbnail")))))
    ratio = F.least(F.lit(1.0), F.lit(float(THUMB_EDGE)) / F.greatest("width", "height"))
    size = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * ratio).cast("bigint"))
    facts = F.array(
        t(iri, N.RDF_TYPE, F.concat(F.lit(N.VOCAB), "class"), "iri"), t(iri, "id", iri, "iri"), t(iri, "mediaPath", F.col("media_path")),
        t(iri, "createdDate", F.col("created")), t(iri, "updatedDate", F.col("created")), t(iri, "mediaType", F.col("media_type")),
        t(iri, "sourceFile", F.col("source_file")), t(iri, "imageSha256Hash", F.col("sha256")), t(iri, "width", F.col("width")),
        t(iri, "height", F.col("height")), t(iri, "renderRequestInformation", F.col("render_request")), t(iri, "thumbnail", thumb, "iri"), t(thumb, N.RDF_TYPE, F.lit(N.v("Thumbnail")), "iri"),
        t(thumb, "id", thumb, "iri"), t(thumb, "path", rendition_path(F.col("kind"), F.col("created"), F.col("id"), F.lit(THUMB_EDGE))),
        t(thumb, "width", size("width")), t(thumb, "height", size("height")), t(thumb, "producedDate", F.col("created")))
    out = rows.filter("reason IS NULL").select("store", F.explode(F.filter(facts, lambda x: x["s"].isNotNull() & x["o"].isNotNull())).alias("x"))
    return out.select("store", "x.*", F.lit(None).cast("string").alias("dt"), F.lit(N.GRAPH).alias("g")).select(*N.QUAD_COLS)


# ── packets ─────────────────────────────────────────────────────────────────────────────────────────────────

R = f"{{{N.RDF}}}"
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_OWN = tuple(f"<{N.MEDIA_NS[len(N.BASE):]}{c}/" for c in ("Image", "Video", "Media"))


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _resolve(about: str, base: str) -> str:
    if not about:
        return base
    return about if ":" in about else base.rsplit("/", 1)[0] + "/" + about


def read_statements(packet: str, media: str, later: bool = False) -> list[tuple]:
    """(block, s, p, o, kind, datatype) of one RDF/XML packet; ValueError when it is not well-formed RDF.

    On arrival the catalogue's own block of another store is passed over; a packet that comes `later` may not hold one, nor say nothing.
    """
    start, end = packet.find("<rdf:RDF"), packet.rfind("</rdf:RDF>")
    if start < 0 or end < start:
        raise ValueError("packet has no rdf:RDF element")
    try:
        root = ET.fromstring(packet[start:end + 10])
    except ET.ParseError as e:
        raise ValueError(f"not valid RDF/XML: {e}") from None
    out: list[tuple] = []
    blanks = iter(range(1 << 30))
    tag = media.rsplit("/", 1)[-1]

    def blank(name: str | None = None) -> str:
        return f"_:{tag}-{next(blanks)}" if name is None else f"_:{tag}-n-{name}"

    def tongue(el: ET.Element, outer: str | None) -> str | None:
        """The language in force: the element's own, or the one around it; empty switches it off."""
        return (el.attrib[XML_LANG] or None) if XML_LANG in el.attrib else outer

    def literal(block: int, s: str, p: str, text: str, lang: str | None, dt: str | None = None) -> None:
        out.append((block, s, p, text, "literal", dt or (f"{N.RDF}langString@{lang}" if lang else None)))

    def link(block: int, s: str, p: str, o: str) -> None:
        out.append((block, s, p, o, "bnode" if o.startswith("_:") else "iri", None))

    def node(el: ET.Element, block: int, lang: str | None) -> str:
        lang = tongue(el, lang)
        if R + "about" in el.attrib:
            s = _resolve(el.attrib[R + "about"], media)
        elif R + "ID" in el.attrib:
            s = f"{media}#{el.attrib[R + 'ID']}"
        else:
            s = blank(el.attrib.get(R + "nodeID"))
        if el.tag != R + "Description":
            out.append((block, s, N.RDF_TYPE, _name(el.tag), "iri", None))
        attributes(el, s, block, lang)
        properties(el, s, block, lang)
        return s

    def properties(el: ET.Element, s: str, block: int, lang: str | None) -> None:
        members = 0
        for prop in el:
            members += prop.tag == R + "li"
            value(prop, s, N.RDF + f"_{members}" if prop.tag == R + "li" else _name(prop.tag), block, lang)

    def said_of(el: ET.Element) -> list[str]:
        return [k for k in el.attrib if k.startswith("{") and not k.startswith("{http://www.w3.org/XML/1998/") and (not k.startswith(R) or k == R + "type")]

    def attributes(el: ET.Element, s: str, block: int, lang: str | None) -> None:
        for k in said_of(el):
            if k == R + "type":
                out.append((block, s, N.RDF_TYPE, el.attrib[k], "iri", None))
            else:
                literal(block, s, _name(k), el.attrib[k], lang)

    def value(prop: ET.Element, s: str, p: str, block: int, lang: str | None) -> None:
        lang, kind = tongue(prop, lang), prop.attrib.get(R + "parseType")
        if kind == "Resource":
            b = blank()
            link(block, s, p, b)
            properties(prop, b, block, lang)
        elif kind == "Collection":
            cells = [node(inner, block, lang) for inner in prop]
            rest = N.RDF + "nil"
            for item in reversed(cells):
                cell = blank()
                link(block, cell, N.RDF + "first", item)
                link(block, cell, N.RDF + "rest", rest)
                rest = cell
            link(block, s, p, rest)
        elif kind is not None:  # Literal, and what else there may be
            inner = (prop.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in prop)
            literal(block, s, p, inner, None, N.RDF + "XMLLiteral")
        elif len(prop):
            for inner in prop:
                link(block, s, p, node(inner, block, lang))
        elif R + "resource" in prop.attrib or R + "nodeID" in prop.attrib or said_of(prop):
            o = _resolve(prop.attrib[R + "resource"], media) if R + "resource" in prop.attrib else blank(prop.attrib.get(R + "nodeID"))
            link(block, s, p, o)
            attributes(prop, o, block, lang)
        else:
            literal(block, s, p, prop.text or "", lang, prop.attrib.get(R + "datatype"))

    outer = tongue(root, None)
    for i, el in enumerate(root):
        own_id = el.findtext(f"{{{N.VOCAB}}}id", "") or el.attrib.get(f"{{{N.VOCAB}}}id", "")
        if not own_id.startswith(_OWN):
            node(el, i, outer)
        elif later:
            raise ValueError("a later packet holds a description of the catalogue's own")
    if later and not out:
        raise ValueError("a later packet states nothing")
    return out


def harvest(packets: DataFrame, later: bool = False) -> DataFrame:
    """Statements of `packets(store, media, packet)`: `rdf:about=""` is the media, named subjects stay, the catalogue's
    own block of another store is left out, or with `later` a fault. A malformed packet is one row with `p` NULL and the fault in `o`."""
    return packets.select("store", "media", "packet").filter(F.col("packet").isNotNull()).mapInArrow(lambda batches: statement_batches(batches, later), STATEMENT_SCHEMA)


def statement_batches(batches: Iterator[pa.RecordBatch], later: bool = False) -> Iterator[pa.RecordBatch]:
    """The statements of batches of packets, passed on once they come from HELD characters, however many packets a batch has."""
    for b in batches:
        rows, held = [], 0
        for store, media, packet in zip(*b.columns, strict=True):
            store, media, packet = store.as_py(), media.as_py(), packet.as_py()
            try:
                rows += [(store, media, *r) for r in read_statements(packet, media, later)]
            except ValueError as e:
                rows.append((store, media, -1, media, None, str(e), "fault", None))
            held += len(packet)
            if held >= HELD:
                yield _statements(rows)
                rows, held = [], 0
        if rows:
            yield _statements(rows)


def _statements(rows: list[tuple]) -> pa.RecordBatch:
    names = ["store", "media", "block", "s", "p", "o", "o_kind", "dt"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "block" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def packet_faults(statements: DataFrame) -> DataFrame:
    return statements.filter("o_kind = 'fault'").select("store", "media", F.col("o").alias("reason"))


def producer_allowed(p: Column) -> Column:
    """A producer may write any namespace but the catalogue's own, of which three names are theirs too."""
    return ~p.startswith(N.VOCAB) | p.isin(*[N.v(x) for x in N.PRODUCER_ALLOWED])


def producer_policy(statements: DataFrame, mode: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """(statements kept, refused names per media). On arrival own-namespace statements are dropped silently; added
    later they refuse the whole media by name."""
    said = statements.filter("o_kind <> 'fault'")
    ok = producer_allowed(F.col("p"))
    refused = said.filter(~ok).groupBy("store", "media").agg(F.sort_array(F.collect_set("p")).alias("names"))
    if mode == "arrival":
        return said.filter(ok), refused.limit(0)
    return said.join(refused, ["store", "media"], "left_anti"), refused


def edges(statements: DataFrame) -> DataFrame:
    """A bracket reference on relatedToId becomes an IRI edge; any other text stays a literal."""
    iri = F.when((F.col("p") == N.v("relatedToId")) & (F.col("o_kind") == "literal"), iri_from_bracket(F.col("o")))
    return (statements.withColumn("__iri", iri).withColumn("o", F.coalesce("__iri", "o"))
            .withColumn("o_kind", F.when(F.col("__iri").isNotNull(), "iri").otherwise(F.col("o_kind"))).drop("__iri"))


def check_dates(statements: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(store, media, reason) of media whose producer dates are too many or no zoned RFC 3339 dates.

    On arrival every value in the packet counts, whatever its subject; later (`existing` quads given) the distinct
    values of the media itself count, those it has included.
    """
    preds = [N.v(x) for x in N.PRODUCER_DATES]
    said = statements.filter(F.col("p").isin(*preds)).select("store", "media", "s", "p", "o", F.lit(True).alias("new"))
    bad = F.max(F.col("new") & ~F.coalesce(is_zoned_date(F.col("o")), F.lit(False))).alias("bad")
    if existing is None:
        per = said.groupBy("store", "media", "p").agg(F.count("*").alias("n"), bad)
    else:
        said = said.filter("s = media")
        have = existing.filter(F.col("p").isin(*preds)).select("store", F.col("s").alias("media"), "s", "p", "o", F.lit(False).alias("new"))
        have = have.join(said.select("store", "media").dropDuplicates(), ["store", "media"], "left_semi")
        per = said.unionByName(have).groupBy("store", "media", "p").agg(F.count_distinct("o").alias("n"), bad)
    local = F.substring_index("p", "/", -1)
    reason = (F.when(F.col("n") > 1, F.concat(local, F.lit(": more than one value")))
              .when(F.col("bad"), F.concat(local, F.lit(": not an RFC3339 date with a zone"))))
    return per.withColumn("reason", reason).groupBy("store", "media").agg(F.min("reason").alias("reason")).filter("reason IS NOT NULL")


def make_named_sets(statements: DataFrame, q: DataFrame, media: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(quads of sets to make, rejects). Sets that `statements` name and no one made yet are made. A media naming a set of the wrong kind, or one that
    cannot be made, because its id is invalid or another node has it, is rejected. `media(store, media, class)`."""
    kind = F.regexp_extract("o", f"^{N.MEDIA_NS}({'|'.join(N.SET_MEMBER)})/([^/]+)$", 1)
    sid = F.regexp_extract("o", f"^{N.MEDIA_NS}({'|'.join(N.SET_MEMBER)})/([^/]+)$", 2)
    named = statements.filter((F.col("p") == N.v("relatedToId")) & (F.col("o_kind") == "iri")).select(
        "store", "media", "o", kind.alias("set_class"), sid.alias("set_id")).filter("set_class <> ''").dropDuplicates()
    named = named.join(media.select("store", "media", "class"), ["store", "media"])
    member = F.try_element_at(F.create_map(*[F.lit(x) for kv in N.SET_MEMBER.items() for x in kv]), F.col("set_class"))
    taken = classes(q, "Image", "Video", "Media", *N.SET_MEMBER).select("store", F.substring_index("s", "/", -1).alias("set_id"), F.col("s").alias("holder"))
    sets = named.select("store", "set_class", "set_id", "o").dropDuplicates().join(taken, ["store", "set_id"], "left").groupBy(
        "store", "set_class", "set_id", "o").agg(F.coalesce(F.max(F.col("holder") == F.col("o")), F.lit(False)).alias("there"), F.count("holder").alias("holders"))
    unmade = F.when(F.col("there"), None).when(~valid_id(F.col("set_id")), "invalid id").when(F.col("holders") > 0, "the id is taken")
    sets = sets.withColumn("unmade", unmade)
    judged = named.join(sets.select("store", "o", "unmade"), ["store", "o"])
    reason = F.when(member != F.col("class"), F.concat(F.lit("wrong kind of set: "), "o")).when(
        F.col("unmade").isNotNull(), F.concat(F.lit("names a set that could not be made: "), "o", F.lit(": "), "unmade"))
    rejects = judged.groupBy("store", "media").agg(F.min(reason).alias("reason")).filter("reason IS NOT NULL")
    wanted = judged.join(rejects, ["store", "media"], "left_anti").select("store", "o").dropDuplicates()
    new = sets.filter("NOT there AND unmade IS NULL").join(wanted, ["store", "o"], "left_semi").select(
        "store", F.col("set_class").alias("class"), F.col("set_id").alias("id"), F.lit(now).alias("created"),
        F.lit(now).alias("updated"), F.lit(None).cast("string").alias("description"))
    return set_quads(new), rejects


def ingest(arrivals: DataFrame, q: DataFrame, packets: DataFrame | None = None, now: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quads, rejects) of arriving files, with the statements of their packets `(path, packet)` if given.

    A media failing any check lands nothing: its facts, statements and the sets only it names stay out. The content is read once: what
    is known of a file is written out narrow and every branch starts there.
    """
    taken = classes(q, "Image", "Video", "Media", *N.SET_MEMBER).select("store", F.substring_index("s", "/", -1).alias("id"))
    rows = cut_lineage(arrival_rows(arrivals, taken))
    rejects = rows.filter("reason IS NOT NULL").select("store", "path", "reason")
    if packets is None:
        return rows, arrival_quads(rows), rejects
    said = cut_lineage(harvest(packets.join(
        rows.filter("reason IS NULL").select("store", "path", F.col("iri").alias("media")), ["store", "path"])))  # parse once
    kept = edges(producer_policy(said)[0])
    _, wrong = make_named_sets(kept, q, rows.select("store", F.col("iri").alias("media"), "class"), now)
    faults = packet_faults(said).unionByName(check_dates(kept)).unionByName(wrong).groupBy("store", "media").agg(F.min("reason").alias("reason"))
    rejects = rejects.unionByName(faults.join(rows.select("store", F.col("iri").alias("media"), "path"), ["store", "media"]).select("store", "path", "reason"))
    good = rows.join(rejects.select("store", "path"), ["store", "path"], "left_anti")
    stated = kept.join(faults, ["store", "media"], "left_anti").select("store", "s", "p", "o", "o_kind", "dt", F.lit(N.GRAPH).alias("g"))
    live = make_named_sets(kept.join(faults, ["store", "media"], "left_anti"), q, rows.select("store", F.col("iri").alias("media"), "class"), now)[0]
    return good, arrival_quads(good).unionByName(stated.dropDuplicates()).unionByName(live), rejects


def legacy_field(statements: DataFrame, ns: str, *names_: str) -> Column:
    """First value of the first name that has one, as an aggregate over a media's statements."""
    return F.coalesce(*[F.min(F.when((F.col("p") == ns + n) & (stripped("o") != ""), stripped("o"))) for n in names_])


def migrate_packets(packets: DataFrame, legacy: str, retired: str, zone: str, drop_subjects: str = "^(Region|Pose):",
                    date_from: str = "name", set_patterns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, outcomes) of packets `(store, media, stem, packet[, file_time])` from an older store.

    The retired namespace and sub-subjects with fixed names go; the media date (from the file name or its time), the
    moment edge and the set edge are added. Ids that cannot be used reject the file with a reason.
    """
    said = cut_lineage(harvest(packets))  # parse once
    kept = said.filter("o_kind <> 'fault'").filter(~F.col("p").startswith(retired) & ~F.col("s").rlike(drop_subjects))
    about = said.groupBy("store", "media").agg(
        legacy_field(said, legacy, "momentId", "Cid", "cid").alias("moment"), legacy_field(said, legacy, "inSetId").alias("in_set"),
        F.min(F.when(F.col("o_kind") == "fault", F.col("o"))).alias("fault"))
    rows = packets.drop("packet").join(about, ["store", "media"], "left")
    date = date_from_name(F.col("stem"), zone) if date_from == "name" else F.col("file_time")
    named = set_from_name(F.col("stem"), set_patterns) if set_patterns is not None else F.lit(None).cast("string")
    rows = rows.withColumn("media_created_date", date).withColumn("set_id", F.coalesce("in_set", named))
    rows = rows.withColumn("reason", F.coalesce(
        F.col("fault"), F.when(F.col("media_created_date").isNull(), "file name holds no date"),
        F.when(F.col("set_id").isNotNull() & ~valid_id(F.col("set_id")), "set id is not usable"),
        F.when(F.col("moment").isNotNull() & ~F.col("moment").rlike("^[A-Za-z0-9:_-]{1,200}$"), "moment id is not usable")))
    good = rows.filter("reason IS NULL")
    one = lambda p, o, k: F.struct(F.lit(N.v(p)).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    extra = F.array(one("mediaCreatedDate", F.col("media_created_date"), "literal"),
                    one("relatedToId", F.concat(F.lit(N.BASE + "moments/Moment/"), "moment"), "iri"),
                    one("relatedToId", F.concat(F.lit(N.MEDIA_NS + "ImageSet/"), "set_id"), "iri"))
    added = good.select("store", "media", F.explode(F.filter(extra, lambda x: x["o"].isNotNull())).alias("x")).select(
        "store", "media", F.lit(-1).alias("block"), F.col("media").alias("s"), "x.p", "x.o", "x.o_kind", F.lit(None).cast("string").alias("dt"))
    out = kept.join(good.select("store", "media"), ["store", "media"], "left_semi").unionByName(added)
    return out, rows.select("store", "media", "moment", "set_id", "media_created_date", "reason")
