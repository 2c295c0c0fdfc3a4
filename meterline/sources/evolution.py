"""Reading files whose columns came, went or changed their type between appends."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Whole-number types in order of width, with the digits that each may need.
_WHOLE = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
MOST_DIGITS = 38
_CLASHES = ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds values of both.

    Whole numbers widen; with a decimal they become a decimal of all digits, beyond 38 of
    them a double; with a float a double (whole numbers over 2^53 then round). A date
    with a timestamp becomes a timestamp. Structs take the fields of both, arrays and maps
    the common types of what they hold. Everything else becomes a string.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType))
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.__getitem__)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _number(a, b)
    if isinstance(a, T.DateType) and isinstance(b, (T.TimestampType, T.TimestampNTZType)):
        return b
    if isinstance(b, T.DateType) and isinstance(a, (T.TimestampType, T.TimestampNTZType)):
        return a
    return T.StringType()


def _number(a: T.DataType, b: T.DataType) -> T.DataType:
    def digits(t: T.DataType) -> tuple[int, int] | None:
        if isinstance(t, T.DecimalType):
            return t.precision - t.scale, t.scale
        return (_WHOLE[t], 0) if t in _WHOLE else None

    x, y = digits(a), digits(b)
    if x and y and (whole := max(x[0], y[0])) + (scale := max(x[1], y[1])) <= MOST_DIGITS:
        return T.DecimalType(whole + scale, scale)
    return T.DoubleType()


def common_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both in order of first appearance; names that differ in case only are one field."""
    found = {f.name.lower(): f for f in a}
    for f in b:
        one = found.get(f.name.lower())
        kind = common_type(one.dataType, f.dataType) if one else f.dataType
        found[f.name.lower()] = T.StructField(one.name if one else f.name, kind)
    return T.StructType([T.StructField(f.name, f.dataType) for f in found.values()])


def as_type(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of type ``have`` as one of ``want``; fields that it lacks are null, a null stays null."""
    if have == want:
        return value
    if isinstance(want, T.StructType):
        own = {f.name.lower(): f for f in have}
        fields = [
            as_type(value[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType).alias(f.name)
            if f.name.lower() in own
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in want
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType):
        entries = F.map_entries(value)
        pair = lambda e: F.struct(
            as_type(e["key"], have.keyType, want.keyType).alias("key"),
            as_type(e["value"], have.valueType, want.valueType).alias("value"),
        )
        return F.map_from_entries(F.transform(entries, pair))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast(want)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Folders and data files directly below a folder, in order of name; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return [f"{path}/{n}" for n in sorted(names) if n[0] not in "._"]


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files at any depth below a folder, oldest first, so those of one write are neighbours."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while listing.hasNext():
        one = listing.next()
        if one.getPath().getName()[0] not in "._":
            found.append((one.getModificationTime(), one.getPath().toString()))
    return [name for _, name in sorted(found)]


def generations(
    spark: SparkSession, path: str, folders: T.StructType = T.StructType([])
) -> list[tuple[list[str], T.StructType]]:
    """Parts of a table whose files agree on all types, each with its schema.

    ``folders`` gives the types of the folder columns, which their names alone do not tell.

    Footers are merged by Spark jobs. Where types clash the list of parts is halved, and a
    folder that clashes with itself becomes its files in order of their age. So a type that
    changed once costs about as many jobs as the number of folders has binary digits.
    Parts that agree are put together again: the scans are as many as the kinds of files.
    """

    levels = {f.name: f for f in folders}

    def merged(parts: Sequence[str]) -> T.StructType | None:
        reader = spark.read.option("mergeSchema", "true").option("basePath", path)
        try:
            return T.StructType([levels.get(f.name, f) for f in reader.parquet(*parts).schema])
        except (PySparkException, Py4JJavaError) as e:  # the latter if a task met the clash
            if any(c in str(e) for c in _CLASHES):
                return None
            raise

    found: list[tuple[list[str], T.StructType]] = []
    waiting = [_children(spark, path)]
    while waiting:
        parts = waiting.pop()
        if not parts:
            continue
        if (schema := merged(parts)) is not None:
            fits = next((i for i, (_, own) in enumerate(found) if _agree(own, schema)), None)
            if fits is None:
                found.append((parts, schema))
            else:
                found[fits] = (found[fits][0] + parts, common_schema(found[fits][1], schema))
        elif len(parts) == 1:
            waiting.append(_files(spark, parts[0]))
        else:
            half = len(parts) // 2
            waiting += [parts[half:], parts[:half]]
    return found


def _agree(a: T.StructType, b: T.StructType) -> bool:
    """True if fields of the same name have the same type in both."""
    own = {f.name: f.dataType for f in a}
    return all(f.dataType == own[f.name] for f in b if f.name in own) and len(
        {n.lower() for n in [*own, *b.names]}
    ) == len({*own, *b.names})


def read_evolved(spark: SparkSession, path: str, folders: T.StructType) -> DataFrame | None:
    """All rows below ``path`` under the common schema of its files; None if it has no file.

    ``folders`` gives the types of the folder columns. Files that agree are one scan, so
    filters and column choices reach every scan.
    """
    groups = generations(spark, path, folders)
    if not groups:
        return None
    want = groups[0][1]
    for _, schema in groups[1:]:
        want = common_schema(want, schema)
    out = None
    for parts, schema in groups:
        rows = spark.read.schema(schema).option("basePath", path).parquet(*parts)
        own = {f.name.lower(): f for f in schema}
        one = rows.select(
            *[
                as_type(F.col(f"`{own[f.name.lower()].name}`"), own[f.name.lower()].dataType, f.dataType).alias(f.name)
                if f.name.lower() in own
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in want
            ]
        )
        out = one if out is None else out.unionByName(one)
    return out
