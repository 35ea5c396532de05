"""Image headers as rows: making, checking, comparing and changing them.

A header table has a column for each field; ``extensions`` is ARRAY<STRUCT<ecode, data>>.
"""

from __future__ import annotations

from html import escape, unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Datatype codes of the image format, with name, bytes and bytes that are swapped together.
TYPES = {1: ("BINARY", 0, 0), 2: ("UINT8", 1, 0), 4: ("INT16", 2, 2), 8: ("INT32", 4, 4), 16: ("FLOAT32", 4, 4), 32: ("COMPLEX64", 8, 4), 64: ("FLOAT64", 8, 8), 128: ("RGB24", 3, 0), 256: ("INT8", 1, 0), 512: ("UINT16", 2, 2), 768: ("UINT32", 4, 4), 1024: ("INT64", 8, 8), 1280: ("UINT64", 8, 8), 1536: ("FLOAT128", 16, 16), 1792: ("COMPLEX128", 16, 8), 2048: ("COMPLEX256", 32, 16), 2304: ("RGBA32", 4, 0)}
INT_TYPES = (2, 4, 8, 256, 512, 768, 1024, 1280)
# Names of the codes for units, coordinate systems and slice orders.
UNITS = {0: "Unknown", 1: "m", 2: "mm", 3: "um", 8: "s", 16: "ms", 24: "us", 32: "Hz", 40: "ppm", 48: "rad/s"}
XFORMS = {0: "Unknown", 1: "Scanner Anat", 2: "Aligned Anat", 3: "Talairach", 4: "MNI_152"}
SLICES = {0: "Unknown", 1: "sequential_increasing", 2: "sequential_decreasing", 3: "alternating_increasing", 4: "alternating_decreasing", 5: "alternating_increasing_2", 6: "alternating_decreasing_2"}
FIELDS = "ndim int, dim array<int>, datatype int, bitpix int, pixdim array<double>, vox_offset double, scl_slope double, scl_inter double, cal_min double, cal_max double, slice_start int, slice_end int, slice_code int, slice_duration double, toffset double, intent_code int, intent_p1 double, intent_p2 double, intent_p3 double, intent_name string, descrip string, aux_file string, qform_code int, sform_code int, quatern_b double, quatern_c double, quatern_d double, qoffset_x double, qoffset_y double, qoffset_z double, srow_x array<double>, srow_y array<double>, srow_z array<double>, xyzt_units int, dim_info int, magic string, extensions array<struct<ecode:int,data:binary>>"
NAMES = [f.split()[0] for f in FIELDS.replace("ecode:int,data", "").split(", ")]
KINDS = dict(f.split(" ", 1) for f in FIELDS.split(", "))


def label(code: Column, names: dict) -> Column:
    """Name of a code, 'Unknown' if it has none."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v if isinstance(v, str) else v[0]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Unknown"))


def new_header(spark: SparkSession, dims: list[int], datatype: int = 16, **fields) -> DataFrame:
    """One row for an empty image."""
    if datatype not in TYPES or not 1 <= len(dims) <= 7 or min(dims) < 1:
        raise ValueError("an image has 1 to 7 positive dimensions and a known datatype")
    zero = {"array": [], "string": "", "int": 0, "double": 0.0}
    row = {n: zero[KINDS[n].split("<")[0]] for n in NAMES}
    row |= {"ndim": len(dims), "dim": [*dims, *[1] * (7 - len(dims))], "datatype": datatype, "bitpix": 8 * TYPES[datatype][1], "pixdim": [1.0] * 7, "vox_offset": 352.0, "magic": "n+1"}
    row |= {"srow_x": [1.0, 0.0, 0.0, 0.0], "srow_y": [0.0, 1.0, 0.0, 0.0], "srow_z": [0.0, 0.0, 1.0, 0.0]}
    if bad := set(fields) - set(NAMES):
        raise ValueError(f"no field {sorted(bad)}")
    row |= fields
    return spark.createDataFrame([tuple(row[n] for n in NAMES)], FIELDS)


def modify(headers: DataFrame, fields: dict) -> DataFrame:
    """headers with other values of some fields, cast to their types."""
    if bad := set(fields) - set(headers.columns):
        raise ValueError(f"no field {sorted(bad)}")
    kinds = dict(headers.dtypes)
    value = lambda v: v if isinstance(v, Column) else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    return headers.withColumns({n: value(v).cast(kinds[n]) for n, v in fields.items()})


def display(headers: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, value) of every row, values as text."""
    fields = fields or [c for c in headers.columns if c in NAMES]
    text = lambda n: F.to_json(n) if dict(headers.dtypes)[n].startswith("array") else F.col(n).cast("string")
    return headers.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), text(n).alias("value")) for n in fields))))


def diff(a: DataFrame, b: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, left, right) of the fields in which two headers differ; nulls are equal."""
    x, y = display(a, fields).alias("x"), display(b, fields).alias("y")
    joined = x.join(y, F.col("x.field") == F.col("y.field"), "full")
    return joined.where(~F.col("x.value").eqNullSafe(F.col("y.value"))).select(F.coalesce("x.field", "y.field").alias("field"), F.col("x.value").alias("left"), F.col("y.value").alias("right"))


def check(headers: DataFrame) -> DataFrame:
    """headers with problems: what is wrong with each, an empty array if nothing is."""
    test = lambda ok, what: F.when(~F.coalesce(ok, F.lit(False)), what)
    used = F.slice("dim", 1, F.greatest(F.lit(1), F.least(F.lit(7), F.coalesce("ndim", F.lit(1)))))
    known = F.col("datatype").isin(*TYPES)
    bits = F.create_map(*(x for k, v in TYPES.items() for x in (F.lit(k), F.lit(8 * v[1] or 1))))
    found = F.array(
        test(F.col("ndim").between(1, 7), "dimensions are not 1 to 7"), test(F.forall(used, lambda d: d > 0), "a dimension is not positive"), test(known, "unknown datatype"),
        F.when(known, test(F.try_element_at(bits, F.col("datatype")) == F.col("bitpix"), "bits do not fit the datatype")), test(F.col("magic").isin("n+1", "ni1", ""), "unknown magic"),
        test((F.col("magic") != "n+1") | (F.col("vox_offset") >= 352), "data begin inside the header"),
        test(F.forall(F.coalesce("extensions", F.array()), lambda e: e["ecode"].isNotNull() & (e["ecode"] >= 0) & (e["ecode"] % 2 == 0)), "an extension's code is odd or negative"),
    )
    return headers.withColumn("problems", F.array_compact(found))


def is_int_type(code: Column) -> Column:
    return code.isin(*INT_TYPES)


def add_extension(headers: DataFrame, ecode: int, data: bytes | str) -> DataFrame:
    """An extension at the end: text of a comment (6) or an XML block (4)."""
    data = data.encode() if isinstance(data, str) else data
    one = F.struct(F.lit(ecode).alias("ecode"), F.lit(bytearray(data)).alias("data"))
    return headers.withColumn("extensions", F.concat(F.coalesce("extensions", F.array().cast("array<struct<ecode:int,data:binary>>")), F.array(one)))


def remove_extension(headers: DataFrame, at: int | None = None) -> DataFrame:
    """Without the extension at an index, or without any."""
    none = F.array().cast("array<struct<ecode:int,data:binary>>")
    return headers.withColumn("extensions", none if at is None else F.filter("extensions", lambda _, k: k != at))


def strip(headers: DataFrame) -> DataFrame:
    """Without extensions and free text."""
    return modify(remove_extension(headers), {"descrip": "", "aux_file": "", "intent_name": ""})


def to_xml_text(s: str) -> str:
    return escape(s, quote=True)


def from_xml_text(s: str) -> str:
    return unescape(s)
