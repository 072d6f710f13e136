"""Loading and saving graphs by an import configuration.

The configuration lists labels (``schema``) and files (``files``): CSV with a
delimiter of one or several characters, or JSON lines (objects or arrays),
header rows to skip, and columns of which ``SRC_ID`` and ``DST_ID`` hold the
ends' primary keys and ``SKIP`` is ignored. Rows that don't fit their types are
an error, or left out with ``continue_on_error``. Everything is read by Spark's
readers in parallel.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.graph import KEY_BITS, GraphError, PropertyGraph, VertexTable, namespaced_id
from arcweave.plans.updates import resolve_ends
from arcweave.runtime import cut, join_bounded

# fixed values: the property types of the configuration
TYPES = {"BOOL": "boolean", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "DATETIME": "timestamp_ntz", "STRING": "string", "BLOB": "binary", "POINT": "string", "LINESTRING": "string", "POLYGON": "string", "FLOAT_VECTOR": "array<float>"}


def _cast(col: Column, kind: str, strict: bool) -> Column:
    if kind == "BLOB":
        return F.unbase64(col)
    if kind == "FLOAT_VECTOR":
        return F.transform(F.split(F.regexp_replace(col.cast("string"), r"[\[\]\s]", ""), ","), lambda x: x.cast("float") if strict else x.try_cast("float"))
    t = TYPES[kind]
    return col if t == "string" else col.cast(t) if strict else col.try_cast(t)


def _read(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """The columns of a file as texts, in order and under their names."""
    names = [f"{c}_{i}" if c == "SKIP" else c for i, c in enumerate(spec["columns"])]
    schema = ", ".join(f"`{n}` string" for n in names)
    if spec.get("format", "CSV").upper() == "CSV":
        head = int(spec.get("header", 0))
        reader = spark.read.option("sep", _delimiter(spec.get("delimiter", ","))).option("quote", '"').option("escape", '"').option("multiLine", bool(spec.get("multiline", False)))
        if head <= 1:
            return reader.option("header", head == 1).option("enforceSchema", True).schema(schema).csv(path)
        if spec.get("multiline"):  # such a file is read by one task, its records in order
            records = reader.schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("@f"), F.monotonically_increasing_id().alias("@i"))
            first = records.groupBy("@f").agg(F.min("@i").alias("@first"))
            return join_bounded(records, first, ["@f"]).filter(F.col("`@i`") - F.col("`@first`") >= head).drop("@f", "@i", "@first")
        lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        from pyspark.sql import Window

        start = lines.filter("b = 0").withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("i"))).filter(F.col("n") <= head).select("f", "i")
        rest = lines.join(F.broadcast(start), ["f", "i"], "left_anti").select("value")  # a few header rows per file
        parsed = rest.select(F.from_csv("value", schema, {"sep": _delimiter(spec.get("delimiter", ",")), "escape": '"'}).alias("r"))
        return parsed.select("r.*")
    raw = spark.read.text(path).filter("trim(value) <> ''")
    start = F.substring(F.trim("value"), 1, 1)
    arr = F.from_json("value", "array<string>")
    obj = F.from_json("value", schema)
    return raw.select(*[F.when(start == "[", F.get(arr, F.lit(i))).otherwise(obj[n]).alias(n) for i, n in enumerate(names)])


def _delimiter(text: str) -> str:
    return text.encode().decode("unicode_escape") if "\\" in text else text


def _typed(df: DataFrame, types: dict[str, str], optional: set[str], strict: bool) -> DataFrame:
    names = [c for c in df.columns if not c.startswith("SKIP")]
    out = df.select(*[_cast(F.col(f"`{n}`"), types[n], strict).alias(n) if n in types else F.col(f"`{n}`") for n in names])
    need = [n for n in names if n in types and n not in optional]
    for n in need:
        out = out.filter(F.col(f"`{n}`").isNotNull()) if not strict else out
    return out


def load(spark: SparkSession, config: dict | str, folder: str, continue_on_error: bool = False) -> PropertyGraph:
    """A graph from a configuration (or the path of its JSON file)."""
    if isinstance(config, str):
        config = json.loads(spark.read.text(config, wholetext=True).first()["value"])
    g, schemas = PropertyGraph(spark), {}
    for s in config["schema"]:
        schemas[s["label"]] = s
    files: dict[tuple, list[dict]] = {}
    for f in config["files"]:
        key = (f["label"], f.get("SRC_ID"), f.get("DST_ID"))
        files.setdefault(key, []).append(f)
    number = 0
    for edge in (False, True):
        for (label, src, dst), specs in files.items():
            s = schemas.get(label)
            if s is None:
                raise GraphError(f"no label {label} in the schema")
            if (s["type"].upper() == "EDGE") != edge:
                continue
            types = {p["name"]: p["type"].upper() for p in s.get("properties", [])}
            optional = {p["name"] for p in s.get("properties", []) if p.get("optional")}
            df = None
            for f in specs:
                one = _typed(_read(spark, str(PurePosixPath(folder) / f["path"]), f), types, optional, not continue_on_error)
                for p, t in types.items():
                    if p not in one.columns:
                        one = one.withColumn(p, F.lit(None).cast(TYPES[t]))
                df = one if df is None else df.unionByName(one)
            if edge:
                g = g.with_edges(label, src, dst, resolve_ends(g, df, src, dst), s.get("temporal"))
                continue
            primary = s["primary"]
            kept = df.filter(F.col(f"`{primary}`").isNotNull()).dropDuplicates([primary])
            if types[primary] in ("INT8", "INT16", "INT32", "INT64"):
                kept = kept.withColumn("_id", namespaced_id(number, primary))
            else:  # other keys: their place in the order of keys
                kept = dense_ids(kept, primary, number)
            number += 1
            g = g.with_vertices(label, kept, primary)
    return g


def dense_ids(df: DataFrame, key: str, number: int = 0) -> DataFrame:
    """``df`` with ``_id``: consecutive numbers in the order of ``key`` (which
    is unique), by range partitions whose sizes are summed up on the driver."""
    from pyspark.sql import Window

    parts = cut(df.repartitionByRange(F.col(f"`{key}`")).withColumn("@part", F.spark_partition_id()))
    sizes = {r["@part"]: r["n"] for r in parts.groupBy("@part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    if not sizes:
        return df.withColumn("_id", F.lit(None).cast("long"))
    start, at = [], 0
    for p in sorted(sizes):
        start += [F.lit(p), F.lit(at)]
        at += sizes[p]
    w = Window.partitionBy("@part").orderBy(key)
    return parts.withColumn("_id", F.lit(number << 48) + F.create_map(*start)[F.col("`@part`")] + F.row_number().over(w) - 1).drop("@part")


def edge_list(spark: SparkSession, path: str, sep: str = " ", weighted: bool = False, text_ids: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``src, dst[, weight]`` of a text file of edges; with ``text_ids`` also
    the mapping ``name, id``."""
    kind = "string" if text_ids else "long"
    df = spark.read.option("sep", sep).option("comment", "#").schema(f"src {kind}, dst {kind}" + (", weight double" if weighted else "")).csv(path)
    if not text_ids:
        return df, None
    names = dense_ids(df.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), "name").select("name", F.col("_id").alias("id"))
    rest = ["weight"] if weighted else []
    out = df.join(names.withColumnRenamed("name", "src").withColumnRenamed("id", "a"), "src").join(names.withColumnRenamed("name", "dst").withColumnRenamed("id", "b"), "dst")
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), names


def _text(name: str, kind: str) -> Column:
    """A property as a text that ``load`` reads back."""
    col = F.col(f"`{name}`")
    return (F.base64(col) if kind == "BLOB" else F.to_json(col) if kind == "FLOAT_VECTOR" else col.cast("string")).alias(name)


def _with_key(df: DataFrame, v: VertexTable, side: str, key: str) -> DataFrame:
    """Edges with the primary key of an end, without those that end nowhere.
    Where ids are made of keys, only the ids are held against the label's, and
    the wide rows go through no join unless some end nowhere."""
    if v.number is None:
        return df.join(v.df.select(F.col("_id").alias(side), F.col(f"`{v.primary}`").alias(key)), side)
    lost = cut(df.select(side).filter(F.col(side).isNotNull()).distinct().join(v.df.select(F.col("_id").alias(side)), side, "left_anti"))
    df = df.filter(F.col(side).isNotNull())
    if not lost.isEmpty():
        df = join_bounded(df, lost, [side], "left_anti")
    return df.withColumn(key, F.col(side).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).cast(v.props[v.primary]))


def export_files(g: PropertyGraph, folder: str, form: str = "JSON", compression: str | None = None) -> dict:
    """Write every label below ``folder`` as CSV (with a header row) or JSON
    lines (compressed by a codec of Spark's, if one is named), edges with the
    primary keys of their ends, and an import configuration beside them
    (``import.json``), which is returned; ``load`` makes the same graph of it.
    Labels need a primary key."""
    form = form.upper()
    names = {v: k for k, v in TYPES.items() if k not in ("POINT", "LINESTRING", "POLYGON")} | {"timestamp": "DATETIME", "array<double>": "FLOAT_VECTOR"}
    config: dict = {"schema": [], "files": []}

    def put(df: DataFrame, kinds: dict[str, str], ends: list[str], name: str) -> dict:
        cols = [*ends, *kinds]
        out = df.select(*[F.col(e).cast("string").alias(e) for e in ends], *[_text(p, k) for p, k in kinds.items()])
        if form == "CSV":
            out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}", compression=compression)
            return {"path": name, "format": "CSV", "header": 1, "multiline": True, "columns": cols}
        out.write.mode("overwrite").json(f"{folder}/{name}", compression=compression)
        return {"path": name, "format": "JSON", "columns": cols}

    def kinds_of(props: dict) -> dict[str, str]:
        out = {}
        for p, t in props.items():
            if t.simpleString() not in names:
                raise GraphError(f"{p} {t.simpleString()} has no type of the configuration")
            out[p] = names[t.simpleString()]
        return out

    for v in g.vertices.values():
        if v.primary is None:
            raise GraphError(f"{v.label} has no primary key")
        kinds = kinds_of(v.props)
        config["schema"].append({"label": v.label, "type": "VERTEX", "primary": v.primary, "properties": [{"name": p, "type": k, "optional": p != v.primary} for p, k in kinds.items()]})
        config["files"].append({"label": v.label, **put(v.df, kinds, [], f"vertex_{v.label}")})
    for label in g.edge_labels():
        mine = [e for e in g.edges if e.label == label]
        kinds = {p: k for e in mine for p, k in kinds_of(e.props).items()}
        config["schema"].append({"label": label, "type": "EDGE", "constraints": [[e.src_label, e.dst_label] for e in mine], "properties": [{"name": p, "type": k, "optional": True} for p, k in kinds.items()]})
        for e in mine:
            df = e.df
            for side, key, end in (("_src", "SRC_ID", e.src_label), ("_dst", "DST_ID", e.dst_label)):
                df = _with_key(df, g.vertices[end], side, key)
            config["files"].append({"label": label, "SRC_ID": e.src_label, "DST_ID": e.dst_label, **put(df, {p: kinds[p] for p in e.props}, ["SRC_ID", "DST_ID"], f"edge_{label}_{e.src_label}_{e.dst_label}")})
    text = g.spark.createDataFrame([(json.dumps(config),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/import.json")
    return config


def export(g: PropertyGraph, folder: str, form: str = "parquet") -> dict:
    """Write every label below ``folder`` (parquet, json or csv; ends of edges
    as ids) and return the list of what was written."""
    out = {"vertices": [], "edges": []}
    for v in g.vertices.values():
        path = f"{folder}/vertex_{v.label}"
        v.df.write.mode("overwrite").format(form).save(path)
        out["vertices"].append({"label": v.label, "primary": v.primary, "path": path})
    for e in g.edges:
        path = f"{folder}/edge_{e.label}_{e.src_label}_{e.dst_label}"
        e.df.write.mode("overwrite").format(form).save(path)
        out["edges"].append({"label": e.label, "src": e.src_label, "dst": e.dst_label, "path": path})
    return out


def restore(spark: SparkSession, listing: dict) -> PropertyGraph:
    """The graph of a parquet ``export``."""
    g = PropertyGraph(spark)
    for v in listing["vertices"]:
        g = g.with_vertices(v["label"], spark.read.parquet(v["path"]), v["primary"])
    for e in listing["edges"]:
        g = g.with_edges(e["label"], e["src"], e["dst"], spark.read.parquet(e["path"]))
    return g
