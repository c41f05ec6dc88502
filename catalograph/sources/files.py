"""Media trees: inventory by path, stored vectors, arriving files, set files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalograph import names as N
from catalograph.functions.text import bare_id, valid_id
from catalograph.sources.nquads import parse_lines

_DAY = "([0-9]{4}/[0-9]{2}/[0-9]{2})"
_STEM = "([0-9]{8}-[0-9]{6})-([A-Za-z0-9_-]+?)"
PICTURE = f"^([a-z]+)/img/([a-z]+)/{_DAY}/{_STEM}(?:_([0-9]+))?\\.([A-Za-z0-9]+)$"
ENRICHMENT = f"^([a-z]+)/enrichment/([a-z]+)/{_DAY}/{_STEM}\\.\\2\\.([A-Za-z0-9_-]+)\\.(?:([A-Za-z0-9_-]+)\\.)?([A-Za-z0-9]+)$"


def parse_media_path(df: DataFrame, col: str = "path") -> DataFrame:
    """Add what a path below the media root says: role, kind, stage, model, item, day, taken, id, long_edge, ext."""
    e = F.col(col).rlike(ENRICHMENT)
    p = F.col(col).rlike(PICTURE) & ~e
    one = lambda pe, pp: F.nullif(F.when(e, F.regexp_extract(col, ENRICHMENT, pe) if pe else F.lit(""))
                                  .when(p, F.regexp_extract(col, PICTURE, pp) if pp else F.lit("")), F.lit(""))
    return df.withColumns({
        "role": F.when(e, "enrichment").when(p, F.regexp_extract(col, PICTURE, 2)).otherwise("other"),
        "kind": one(1, 1), "stage": one(2, 0), "model": one(6, 0), "item": one(7, 0), "day": F.translate(one(3, 3), "/", "-"),
        "taken": one(4, 4), "id": one(5, 5), "long_edge": one(0, 6).try_cast("int"), "ext": one(8, 7)})


def relative_path(path: Column, root: str) -> Column:
    """A file path as the reader reports it, from the media root on."""
    mark = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return F.substr(path, F.instr(path, mark) + len(mark))


def scan_media(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of a media tree. Only names, sizes and times are read: no content column is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return parse_media_path(files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), "modificationTime"))


def decode_npy(content: Column) -> Column:
    """A `.npy` file of one little-endian f32 row as an array; anything else fails the read."""
    @F.arrow_udf("array<float>")
    def decode(batch: pa.Array) -> pa.Array:
        out = []
        for b in batch.to_pylist():
            if b is None:
                out.append(None)
                continue
            if b[:6] != b"\x93NUMPY":
                raise ValueError("not a .npy file")
            wide = b[6] >= 2
            start = (12 if wide else 10) + int.from_bytes(b[8:12 if wide else 10], "little")
            head = b[10:start].decode("latin1")
            if "'<f4'" not in head or "'fortran_order': False" not in head:
                raise ValueError(f"not a C-order f32 array: {head}")
            out.append(np.frombuffer(b, "<f4", offset=start))
        return pa.array(out, pa.list_(pa.float32()))
    return decode(content)


def load_vectors(spark: SparkSession, root: str, records: DataFrame) -> DataFrame:
    """`records(path, …)` with the vector each path holds, NULL where the file is gone.

    The file listing is joined on the path, so files no record names are listed but never decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)
    named = files.select(relative_path(F.col("path"), root).alias("path"), "content").join(records.select("path").dropDuplicates(), "path", "left_semi")
    return records.join(named.select("path", decode_npy(F.col("content")).alias("vec")), "path", "left")


def arrivals(spark: SparkSession, root: str, store: str, stream: bool = True, max_files: int = 1000) -> DataFrame:
    """Arriving files `(store, batch, path, content, claimed, created)`, as a stream or a batch. `created` is when the
    file landed, so a retried batch says the same."""
    from catalograph.functions.text import mime_of

    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    files = (reader.option("maxFilesPerTrigger", max_files) if stream else reader).load(root)
    return files.select(F.lit(store).alias("store"), F.lit("files").alias("batch"), "path", "content", mime_of(F.col("path")).alias("claimed"),
                        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("created"))


def sets_from_lines(lines: DataFrame, class_: str, store: str) -> DataFrame:
    """Sets of `lines(file, value)`, a file a set. A file must hold exactly one node, typed with the class, that says its
    own id, in the one graph, with a creation date and nothing a set does not carry; anything else fails the read."""
    q = parse_lines(lines, store=F.lit(store))
    allowed = {"createdDate", "updatedDate", "description"}
    node, typed = F.min("s"), F.max((F.col("p") == N.RDF_TYPE) & (F.col("o") == N.v(class_)) & (F.col("o_kind") == "iri"))
    literal = (F.col("o_kind") == "literal") & F.col("p").isin(*[N.v(f) for f in allowed])
    known = literal | (F.col("p") == N.v("id")) | ((F.col("p") == N.RDF_TYPE) & (F.col("o") == N.v(class_)))
    pick = lambda f: F.max(F.when(F.col("p") == N.v(f), F.col("o"))).alias(f)
    per = q.groupBy("store", "file").agg(
        node.alias("iri"), F.count_distinct("s").alias("nodes"), typed.alias("typed"), F.min(known).alias("clean"),
        F.min(F.col("g").eqNullSafe(F.lit(N.GRAPH))).alias("one_graph"), F.max((F.col("p") == N.v("id")) & (F.col("s") == F.col("o"))).alias("says_id"),
        *[pick(f) for f in sorted(allowed)])
    id_ = bare_id(F.col("iri"))
    fault = (F.when(~F.col("one_graph"), "holds a statement of another graph").when(F.col("nodes") > 1, "speaks of more than one node")
             .when(~F.col("says_id"), "never states its id").when(~F.col("clean"), "carries an unknown statement")
             .when(~F.col("typed"), f"is not typed {class_}").when(F.col("createdDate").isNull(), "lacks its creation date")
             .when(~F.col("iri").startswith(f"{N.MEDIA_NS}{class_}/") | ~valid_id(id_), "has an id that cannot be used")
             .when(F.regexp_replace(F.substring_index("file", "/", -1), "\\.nq$", "") != id_, "has a name other than its id"))
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("set file "), F.col("file"), F.lit(" "), fault))).otherwise(id_)
    return per.select("store", F.lit(class_).alias("class"), checked.alias("id"), F.col("createdDate").alias("created"),
                      F.col("updatedDate").alias("updated"), "description")


def load_sets(spark: SparkSession, path: str, class_: str, store: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.url_decode(F.col("_metadata.file_path")).alias("file"))
    return sets_from_lines(lines, class_, store)
