"""Strict reading of nested JSON documents: unknown keys, missing fields, values of a
wrong type or outside their choices send a document to quarantine, defaults fill the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, MapType, StringType, StructField, StructType

from ..functions.semi import get, is_object
from ..plans.rows import computed
from ..plans.session import few_listings, last_key_counts, written

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _inside(fn, *args):
    """``fn`` over an array element, with the other arguments fixed."""
    return lambda v: fn(v, *args)


def _not_in(leaf: str, allowed: list[str]):
    return lambda v: ~F.coalesce(v[leaf].isin(allowed), F.lit(True))


def unknown_keys(doc: Column, schema: StructType, path: str = "") -> Column:
    """Paths of keys that ``schema`` does not know, as an array."""
    keys = F.map_keys(get(doc, "$", "map<string,variant>"))
    extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in schema]))
    found = [F.transform(extra, lambda k: F.concat(F.lit(path), k))]
    for f in schema:
        if isinstance(f.dataType, StructType):
            found.append(unknown_keys(get(doc, f"$.{f.name}", "variant"), f.dataType, f"{path}{f.name}."))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            inner, where = f.dataType.elementType, f"{path}{f.name}[]."
            items = get(doc, f"$.{f.name}", "array<variant>")
            found.append(F.flatten(F.transform(items, _inside(unknown_keys, inner, where))))
    return F.concat(*[F.coalesce(c, _empty()) for c in found])


# Texts that are read as flags, whatever their case.
TRUE_TEXTS = ["1", "on", "t", "true", "y", "yes"]
FALSE_TEXTS = ["0", "off", "f", "false", "n", "no"]
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


# The functions below write SQL text: a document has some hundred conditions, and Spark reads one text faster than it
# takes as many calls.

def _leaf(text: str, kind: DataType) -> str:
    """A scalar from the text of its JSON value; null if it does not fit ``kind``. Numbers may be given as texts, and
    whole numbers with a fraction of zero."""
    real = f"coalesce(try_cast({text} as double), case {text} when 'true' then 1D when 'false' then 0D end)"
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, DoubleType):
        return real
    if isinstance(kind, BooleanType):
        true, false = (", ".join(f"'{w}'" for w in words) for words in (TRUE_TEXTS, FALSE_TEXTS))
        return f"case when lower({text}) in ({true}) or {real} = 1 then true when lower({text}) in ({false}) or {real} = 0 then false end"
    whole = f"coalesce(try_cast({text} as bigint), case when {real} % 1 = 0 then try_cast({real} as bigint) end)"
    return f"try_cast({whole} as {kind.simpleString()})"


def _part(value: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def _plainly(value: str, kind: DataType) -> str:
    """Whether a VARIANT holds a JSON number or flag that fits ``kind`` as it is: what most values are, told without a text."""
    given = f"schema_of_variant({value})"
    if isinstance(kind, BooleanType):
        return f"{given} = 'BOOLEAN'"
    if isinstance(kind, DoubleType):
        return f"{given} = 'BIGINT' or {given} = 'DOUBLE' or startswith({given}, 'DECIMAL')"
    return f"{given} = 'BIGINT' and {_part(value, '$', kind.simpleString())} is not null"


def _misfit(value: str, kind: DataType) -> str:
    """Whether a VARIANT is null or does not hold a scalar of ``kind``."""
    said, given = _part(value, "$", "string"), f"schema_of_variant({value})"
    if isinstance(kind, StringType):
        fits = f"{given} = 'STRING'"
    else:
        fits = f"{_leaf(said, kind)} is not null"
        if not isinstance(kind, BooleanType):
            fits += f" and ({given} = 'BOOLEAN' or {said} rlike r'{NUMBER}')"
        fits = f"({_plainly(value, kind)}) or ({fits})"
    return f"(is_variant_null({value}) or not coalesce({fits}, false))"


_NOTHING = f"cast(array() as {_NONE})"


def _object(value: str) -> str:
    return f"({_part(value, '$', 'struct<_:variant>')} is not null)"


def _with_fields(doc: str, schema: StructType, name: str, body: str) -> str:
    """``body`` with ``name`` for the fields of an object that ``schema`` knows, each as a VARIANT. They are taken out of the
    object once, however often ``body`` asks for them."""
    fields = ",".join(f"`{f.name}`:variant" for f in schema)
    return f"element_at(transform(array({_part(doc, '$', f'struct<{fields}>')}), {name} -> {body}), 1)"


def missing_fields(doc: str, schema: StructType, path: str = "", depth: int = 0) -> str:
    """Paths of required fields that are absent or null."""
    found, o, v = [], f"m{depth}", f"n{depth}"
    for f in schema:
        value, kind, where = f"{o}.{f.name}", f.dataType, f"{path}{f.name}"
        if not f.nullable:
            found.append(f"case when {value} is null or is_variant_null({value}) then array('{where}') else {_NOTHING} end")
        if isinstance(kind, StructType):
            found.append(f"case when {_object(value)} then {missing_fields(value, kind, where + '.', depth + 1)} else {_NOTHING} end")
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            items = f"filter({_part(value, '$', 'array<variant>')}, {v} -> {_object(v)})"
            each = missing_fields(v, kind.elementType, where + "[].", depth + 1)
            found.append(f"case when {value} is null then {_NOTHING} else coalesce(flatten(transform({items}, {v} -> {each})), {_NOTHING}) end")
    return _with_fields(doc, schema, o, f"concat({', '.join(found)})") if found else _NOTHING


def _never_null(f: StructField) -> bool:
    return isinstance(f.dataType, (ArrayType, MapType)) or "default" in f.metadata or f.metadata.get("never_null", False)


def wrong_types(doc: str, schema: StructType, path: str = "", depth: int = 0) -> str:
    """Paths of values that are there but are not of their field's type. Null is a value of optional parts and of
    optional scalars without a default only; a required field that is null is missing."""
    found, v, o = [], f"v{depth}", f"o{depth}"
    for f in schema:
        value, kind, where = f"{o}.{f.name}", f.dataType, f"{path}{f.name}"
        bad, parts = f"array('{where}')", _NOTHING
        if isinstance(kind, StructType):
            right, parts = _object(value), wrong_types(value, kind, where + ".", depth + 1)
        elif isinstance(kind, ArrayType):
            inner, items = kind.elementType, _part(value, "$", "array<variant>")
            right, nested = f"{items} is not null", isinstance(inner, StructType)
            odd = f"not {_object(v)}" if nested else _misfit(v, inner)
            parts = f"case when exists({items}, {v} -> {odd}) then array('{where}[]') else {_NOTHING} end"
            if nested:
                each = wrong_types(v, inner, where + "[].", depth + 1)
                parts = f"concat({parts}, flatten(transform(filter({items}, {v} -> {_object(v)}), {v} -> {each})))"
        elif isinstance(kind, MapType):
            right, entries = _object(value), f"map_values({_part(value, '$', 'map<string,variant>')})"
            parts = f"case when exists({entries}, {v} -> {_misfit(v, kind.valueType)}) then array('{where}{{}}') else {_NOTHING} end"
        else:
            right = _object(value) if f.metadata.get("object") else f"not {_misfit(value, kind)}"
        null = bad if f.nullable and _never_null(f) else _NOTHING
        found.append(f"case when {value} is null then {_NOTHING} when is_variant_null({value}) then {null} when {right} then {parts} else {bad} end")
    return _with_fields(doc, schema, o, f"concat({', '.join(found)})")


# Objects whose keys need no quotes and that hold no others, in the text of ``schema_of_variant``.
_FLAT_OBJECT = "OBJECT<[^<>`]*>"
_REAL = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"


def _plain_shape(kind: DataType) -> str:
    """A pattern for what ``schema_of_variant`` says of values that fit ``kind`` as they are and have no key that ``kind``
    does not know; nulls and absent fields fit too, as they do not show there."""
    if isinstance(kind, StructType):
        shapes = [(f.name, f"(?:{_FLAT_OBJECT}|VOID)" if f.metadata.get("object") else _plain_shape(f.dataType)) for f in kind]
        fields = "".join(f"(?:{name}: {shape}(?:, |(?=>)))?" for name, shape in sorted(shapes))
        return f"(?:OBJECT<{fields}>|VOID)"
    if isinstance(kind, ArrayType):
        return f"(?:ARRAY<{_plain_shape(kind.elementType)}>|VOID)"
    if isinstance(kind, MapType):  # any number of keys: their values are looked at as texts
        return f"(?:{_FLAT_OBJECT}|VOID)"
    if isinstance(kind, DoubleType):
        return f"(?:{_REAL}|VOID)"
    return f"(?:{'STRING' if isinstance(kind, StringType) else 'BOOLEAN' if isinstance(kind, BooleanType) else 'BIGINT'}|VOID)"


def _doubtful(value: str, kind: DataType, null: bool, depth: int = 0) -> str:
    """Whether the texts of a document's scalars leave it open that a value is missing, null where it may not be (``null``
    tells whether it may) or too large a whole number."""
    v, inner = f"d{depth}", "false"
    if isinstance(kind, StructType):
        inner = " or ".join(_doubtful(f"{value}.{f.name}", f.dataType, f.nullable and not _never_null(f), depth) for f in kind) or "false"
    elif isinstance(kind, ArrayType):
        inner = f"exists({value}, {v} -> {_doubtful(v, kind.elementType, False, depth + 1)})"
    elif isinstance(kind, MapType):
        inner = f"exists(map_values({value}), {v} -> not coalesce({_leaf(v, kind.valueType)} is not null and {v} rlike r'{NUMBER}', false))"
    elif not isinstance(kind, (StringType, DoubleType, BooleanType)):
        inner = f"try_cast({value} as {kind.simpleString()}) is null"
    return f"({value} is not null and ({inner}))" if null else f"({value} is null or {inner})"


def plainly_right(doc: str, value: str, schema: StructType) -> str:
    """Whether a document, as a VARIANT and as the texts of its scalars, has no unknown key, no missing field and no wrong
    type, told from its shape as a whole. What this leaves open is looked at field by field."""
    return f"schema_of_variant({doc}) rlike r'^{_plain_shape(schema)}$' and not {_doubtful(value, schema, False)}"


def bad_choices(value: Column, choices: dict[str, list[str]]) -> Column:
    """Paths whose value is none of the allowed ones; missing values are allowed."""
    found = []
    for path, allowed in choices.items():
        head, _, leaf = path.rpartition(".")
        column = value[head.split(".")[0]]
        for part in head.split(".")[1:]:
            column = column[part]
        wrong = ~F.coalesce(column[leaf].isin(allowed), F.lit(True))
        if path.split(".")[0] in ("video", "audio", "ost", "annotations", "signals"):
            wrong = F.exists(column, _not_in(leaf, allowed))
        found.append(F.when(F.coalesce(wrong, F.lit(False)), F.array(F.lit(path))).otherwise(_empty()))
    return F.concat(*found)


def with_defaults(value: str, schema: StructType, texts: bool = False, depth: int = 0) -> str:
    """Fill missing optional fields, at every depth. With ``texts``, scalars are still the texts of their JSON values and
    are read first."""
    fields, v = [], f"v{depth}"
    for f in schema:
        c, kind = f"{value}.{f.name}", f.dataType
        if isinstance(kind, StructType):
            filled = with_defaults(c, kind, texts, depth)
            c = filled if f.metadata.get("never_null") else f"case when {c} is not null then {filled} end"
        elif isinstance(kind, ArrayType):
            if isinstance(kind.elementType, StructType):
                c = f"transform({c}, {v} -> {with_defaults(v, kind.elementType, texts, depth + 1)})"
            c = f"coalesce({c}, cast(array() as {_relaxed(kind).simpleString()}))"
        elif isinstance(kind, MapType):
            c = f"transform_values({c}, (k, {v}) -> {_leaf(v, kind.valueType)})" if texts else c
            c = f"coalesce({c}, cast(map() as {kind.simpleString()}))"
        else:
            c = _leaf(c, kind) if texts else c
            if "default" in f.metadata:
                default = f.metadata["default"]
                c = f"coalesce({c}, cast('{str(default).lower() if isinstance(default, bool) else default}' as {kind.simpleString()}))"
        fields.append(f"'{f.name}', {c}")
    return f"named_struct({', '.join(fields)})"


def _relaxed(kind):
    """The same type with every field nullable."""
    if isinstance(kind, StructType):
        out = StructType()
        for f in kind:
            out.add(f.name, _relaxed(f.dataType), True)
        return out
    if isinstance(kind, ArrayType):
        return ArrayType(_relaxed(kind.elementType), True)
    return kind


def _texts(kind):
    """The same shape with every scalar as the text of its JSON value."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _texts(f.dataType), True) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_texts(kind.elementType), True)
    return MapType(StringType(), StringType()) if isinstance(kind, MapType) else StringType()


def parse_documents(
    texts: DataFrame, column: str, schema: StructType, choices: dict[str, list[str]] | None = None, *, aside: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split rows of JSON text into (documents, rejects).

    Documents carry the fields of ``schema`` beside the other columns; rejects
    carry the text and a ``problems`` array. Of a repeated key the last value counts. With ``aside``, the judged rows are
    written aside, so that a caller of both halves has every text read once.
    """
    last_key_counts(texts.sparkSession)
    raw = F.col(column)
    others = [c for c in texts.columns if c != column]
    read = computed(texts, {"_doc": F.from_json(raw, _texts(schema)), "_v": F.try_parse_json(raw)})
    problems = F.when(~F.coalesce(is_object(F.col("_v")), F.lit(False)) | F.col("_doc").isNull(), F.array(F.lit("not a JSON object"))).otherwise(
        F.concat(
            F.when(F.expr(plainly_right("_v", "_doc", schema)), _empty()).otherwise(F.concat(
                F.transform(unknown_keys(F.col("_v"), schema), lambda k: F.concat(F.lit("unknown key: "), k)),
                F.transform(F.expr(missing_fields("_v", schema)), lambda k: F.concat(F.lit("missing field: "), k)),
                F.transform(F.expr(wrong_types("_v", schema)), lambda k: F.concat(F.lit("wrong type: "), k)))),
            *([F.transform(bad_choices(F.col("_doc"), choices), lambda k: F.concat(F.lit("bad value: "), k))]
              if choices else []),
        )
    )
    judged = computed(read, {"problems": problems})
    if aside:
        judged = written(judged.drop("_v"), "judged")
    good = judged.filter(F.size("problems") == 0).select(
        *others, F.expr(with_defaults("_doc", schema, texts=True)).alias("_full")
    ).select(*others, "_full.*")
    bad = judged.filter(F.size("problems") > 0).select(*others, raw.alias("text"), "problems")
    return good, bad


def read_texts(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Whole files below ``path`` as ``path, text``; ``name`` picks a file name."""
    reader = spark.read.option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    few_listings(spark)
    return reader.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")
    )


def plain_path(uri: Column) -> Column:
    """A local file URI as a path; other schemes stay as they are."""
    return F.regexp_replace(uri, r"^file:(//)?", "")


def write_documents(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON document per row; ``partition`` gives each value its own folder."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    if partition:
        writer = writer.partitionBy(partition)
    writer.json(path)
