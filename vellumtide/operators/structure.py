"""Document structure as relations: metadata, inheritance, labels, outline, links, forms, attachments, reachability, object streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumtide.functions.text import format_label

# Information keys, link kinds and form flags.
INFO_KEYS = ("title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate")
LINK_NONE, LINK_GOTO, LINK_URI, LINK_LAUNCH, LINK_NAMED, LINK_GOTOR = range(6)
RADIO, PUSHBUTTON, COMBO = 1 << 15, 1 << 16, 1 << 17
PER_OBJECT_STREAM = 100
MAX_FIELD_DEPTH = 32


def metadata(info: Column, version: Column) -> list[Column]:
    """The eight entries, "" where missing, and the format."""
    return [*[F.coalesce(F.try_element_at(info, F.lit(k)), F.lit("")).alias(k) for k in INFO_KEYS], F.concat(F.lit("PDF "), version).alias("format")]


def set_metadata(info: Column, updates: dict[str, str]) -> Column:
    """The map with updates in place; an empty value deletes. All keys and types are checked before anything changes."""
    for k, v in updates.items():
        if k not in INFO_KEYS:
            raise ValueError(f"no such metadata key: {k}")
        if not isinstance(v, str):
            raise TypeError(f"metadata values are strings, {k} isn't")
    if not updates:
        return info
    kept = F.map_filter(info, lambda k, v: ~k.isin(*updates))
    new = F.create_map(*[F.lit(x) for kv in updates.items() for x in kv])
    return F.map_filter(F.map_concat(kept, new), lambda k, v: v != "")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder (spark.checkpoint.dir), where there is one; the plan only grows without it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def inherited(nodes: DataFrame) -> DataFrame:
    """nodes: id, parent, value. Every id with its own value or that of its nearest ancestor, and an error where its parents form a cycle. Pointer doubling: a join a
    round, as many rounds as the logarithm of the deepest tree."""
    out = _cut(nodes.select("id", F.when(F.col("value").isNull(), F.col("parent")).alias("up"), "value"))
    left = nodes.count() + 1
    while left and not out.where("up is not null").isEmpty():
        look = out.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("value").alias("theirs"))
        out = _cut(out.join(look, "up", "left").select("id", F.when(F.col("theirs").isNull(), F.col("next")).alias("up"), F.coalesce("value", "theirs").alias("value")))
        left //= 2
    return out.select("id", "value", F.when(F.col("up").isNotNull(), F.lit("the parents form a cycle")).alias("error"))


def dotted_names(nodes: DataFrame) -> DataFrame:
    """nodes: id, parent, name, kind, flags. Full names joined by dots from the root down, kind and flags inherited; level by level, until none is below."""
    front = _cut(nodes.where("parent is null").select("id", F.col("name").alias("full_name"), "kind", "flags", F.lit(0).alias("depth")))
    out, depth = None, 0
    while not front.isEmpty():
        out, depth = front if out is None else out.unionByName(front), depth + 1
        up = front.select(F.col("id").alias("parent"), F.col("full_name").alias("above"), F.col("kind").alias("k0"), F.col("flags").alias("f0"))
        front = _cut(nodes.join(up, "parent").select("id", F.concat_ws(".", "above", "name").alias("full_name"), F.coalesce("kind", "k0").alias("kind"), F.coalesce("flags", "f0").alias("flags"), F.lit(depth).alias("depth")))
    return front if out is None else out


def field_type(kind: Column, flags: Column) -> Column:
    f = F.coalesce(flags, F.lit(0))
    return (
        F.when(kind == "Tx", "text")
        .when(kind == "Sig", "signature")
        .when(kind == "Ch", F.when(f.bitwiseAND(COMBO) != 0, "combobox").otherwise("listbox"))
        .when(kind == "Btn", F.when(f.bitwiseAND(PUSHBUTTON) != 0, "button").when(f.bitwiseAND(RADIO) != 0, "radio").otherwise("checkbox"))
        .otherwise("unknown")
    )


def fill_fields(fields: DataFrame, updates: DataFrame) -> DataFrame:
    """fields: name, type, value; updates: name, new_value. The fields with new values; an update of a signature is an error in its row."""
    j = fields.join(updates, "name", "left")
    asked = F.col("new_value").isNotNull()
    return j.select("name", "type", F.when(asked & (F.col("type") != "signature"), F.col("new_value")).otherwise(F.col("value")).alias("value"), F.when(asked & (F.col("type") == "signature"), F.lit("signatures can't be filled in")).alias("error"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages: doc_id, pno; labels: doc_id, startpage, style, prefix, firstpagenum. Every page with its label: an as-of join by one window over both."""
    a = pages.select("doc_id", F.col("pno").cast("long").alias("at"), F.lit(1).alias("is_page"), F.lit(None).cast("struct<startpage: long, style: string, prefix: string, firstpagenum: long>").alias("range"))
    r = F.struct(F.col("startpage").cast("long").alias("startpage"), F.col("style").cast("string").alias("style"), F.col("prefix").cast("string").alias("prefix"), F.col("firstpagenum").cast("long").alias("firstpagenum"))
    b = labels.select("doc_id", F.col("startpage").cast("long").alias("at"), F.lit(0).alias("is_page"), r.alias("range"))
    w = Window.partitionBy("doc_id").orderBy("at", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("range", F.last("range", ignorenulls=True).over(w)).where("is_page = 1")
    label = format_label(F.col("range.prefix"), F.col("range.style"), F.col("range.firstpagenum") + F.col("at") - F.col("range.startpage"))
    return both.select("doc_id", F.col("at").alias("pno"), F.coalesce(F.when(F.col("range").isNotNull(), label), F.lit("")).alias("label"))


def check_labels(labels: DataFrame) -> DataFrame:
    """doc_id and the fault of label ranges that can't be written: the first begins at 0, starts are unique, styles known, numbers at least 1."""
    g = labels.groupBy("doc_id").agg(F.min("startpage").alias("first"), (F.count("*") - F.countDistinct("startpage")).alias("twice"), F.sum((~F.col("style").isin("D", "R", "r", "A", "a", "")).cast("int")).alias("odd"), F.min("firstpagenum").alias("least"))
    fault = F.when(F.col("first") != 0, "the first range must begin at page 0").when(F.col("twice") > 0, "two ranges begin at one page").when(F.col("odd") > 0, "an unknown style").when(F.col("least") < 1, "numbers begin at 1")
    return g.select("doc_id", fault.alias("fault")).where("fault is not null")


def check_toc(toc: DataFrame) -> DataFrame:
    """toc: doc_id, seq, level. Entries with whether their level may follow the one before: the first is 1, none skips a level."""
    prev = F.lag("level", 1, 0).over(Window.partitionBy("doc_id").orderBy("seq"))
    return toc.withColumn("ok", (F.col("level") >= 1) & (F.col("level") <= prev + 1))


def toc_parents(toc: DataFrame) -> DataFrame:
    """toc with the seq of each entry's parent: the last entry before it of the next higher level."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    levels = [r["level"] for r in toc.select("level").distinct().collect()]  # a handful of outline depths
    parent = F.lit(None).cast("long")
    for v in sorted(levels):
        parent = F.when(F.col("level") == v, F.last(F.when(F.col("level") == v - 1, F.col("seq")), ignorenulls=True).over(w)).otherwise(parent)
    return toc.withColumn("parent", parent)


def resolve_links(annots: DataFrame, pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """annots: doc_id, seq, uri, dest (page object), named, file, launch. Kinds and page numbers: by name first, then by the page's object; -1 where neither is known.
    pages: doc_id, obj_num, pno; names: doc_id, named, named_dest."""
    a = annots
    if names is not None:
        a = a.join(names, ["doc_id", "named"], "left").withColumn("dest", F.coalesce("dest", "named_dest"))
    a = a.join(pages.select("doc_id", F.col("obj_num").alias("dest"), F.col("pno").alias("_pno")), ["doc_id", "dest"], "left")
    inner = F.col("dest").isNotNull() | F.col("named").isNotNull()
    kind = F.when(F.col("uri").isNotNull(), LINK_URI).when(F.col("file").isNotNull(), LINK_GOTOR).when(F.col("launch").isNotNull(), LINK_LAUNCH).when(F.col("dest").isNotNull(), LINK_GOTO).when(F.col("named").isNotNull(), LINK_NAMED).otherwise(LINK_NONE)
    return a.select("doc_id", "seq", kind.alias("kind"), "uri", F.when(inner & F.col("uri").isNull(), F.coalesce("_pno", F.lit(-1))).alias("page"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges: src, dst; start: id. All ids that can be reached; a join a round over new ids alone, until there are none."""
    seen = front = _cut(start.select("id").distinct())
    while not front.isEmpty():
        front = _cut(front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = _cut(seen.unionByName(front))
    return seen


def prune(objects: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    return objects.join(reachable(edges, start), "id", "left_semi")


def distinct_warnings(faults: DataFrame) -> DataFrame:
    """faults: doc_id, seq, message. Every message of a document once, with the seq of its first occurrence."""
    return faults.groupBy("doc_id", "message").agg(F.min("seq").alias("first_seen"))


def ordered_attachments(files: DataFrame) -> DataFrame:
    """files: doc_id, name and further columns. Attachments with their number in the document and their place by name."""
    of = Window.partitionBy("doc_id")
    return files.withColumn("n", F.count("*").over(of)).withColumn("place", F.row_number().over(of.orderBy("name")).cast("long"))


def pack_objects(objects: DataFrame) -> DataFrame:
    """objects: doc_id, obj_num. The object stream and the place in it of every object."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("obj_num")) - 1
    return objects.withColumn("stream", F.floor(n / PER_OBJECT_STREAM).cast("long")).withColumn("slot", F.pmod(n, F.lit(PER_OBJECT_STREAM)).cast("long"))


def pdfa_claim(xmp: Column) -> list[Column]:
    """Part and conformance that XMP metadata claim, in attribute or element form."""
    pick = lambda k, v: F.regexp_extract(xmp, f"pdfaid:{k}\\s*(?:=\\s*[\"']|>)\\s*({v})", 1)
    part, level = pick("part", "[0-9]+"), pick("conformance", "[A-Za-z]+")
    return [F.when(part != "", part.cast("int")).alias("part"), F.when(level != "", level).alias("conformance")]
