"""Nested and JSON values: flattening, rewriting items, dropping nulls, finding references."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pipelinekit.functions.text import package_parts, reference_fields


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Expand structs and explode arrays into ``a-b-c`` columns.

    A row with an empty or null array stays, with nulls. ``keep`` selects some of the
    flattened columns, so that unneeded ones are never expanded by the plan. Arrays side
    by side are matched by position, shorter ones ending in nulls, so they don't multiply.
    """
    def nested(kind: type) -> list[str]:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]

    while nested(ArrayType) or nested(StructType):
        arrays = nested(ArrayType)
        if arrays:
            # An absent array must not make the others absent.
            filled = [F.coalesce(F.col(quoted(name)), F.array().cast(df.schema[name].dataType)) for name in arrays]
            df = df.withColumn("__item", F.explode_outer(F.arrays_zip(*filled)))
            df = df.withColumns({name: F.col("__item").getField(str(i)) for i, name in enumerate(arrays)}).drop("__item")
        columns = []
        for f in df.schema.fields:
            value = F.col(quoted(f.name))
            if isinstance(f.dataType, StructType):
                columns += [value.getField(g.name).alias(f"{f.name}-{g.name}") for g in f.dataType.fields]
            else:
                columns.append(value)
        df = df.select(*columns)
    return df.select(*[F.col(quoted(name)) for name in keep]) if keep else df


def without_nulls(value: Column, kind: DataType) -> Column:
    """Drop null items of arrays and null entries of maps, at every depth."""
    if isinstance(kind, ArrayType):
        items = F.filter(value, lambda item: item.isNotNull())
        return F.transform(items, lambda item: without_nulls(item, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.map_filter(value, lambda _, item: item.isNotNull())
        return F.transform_values(entries, lambda _, item: without_nulls(item, kind.valueType))
    if isinstance(kind, StructType):
        fields = [without_nulls(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def drop_nulls_json(value: Column, kind: StructType | ArrayType | MapType) -> Column:
    """JSON text of a value without its null fields, items and entries, at every depth."""
    return F.to_json(without_nulls(value, kind), {"ignoreNullFields": "true"})


# The processes of a job document, in one parse, with the fields that queries ask for.
JOB = "processes map<string, struct<component:string, properties:struct<pipelineId:string, clusterSize:string>>>"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# What opens and closes, and the three keys that make a reference with the text or opening they have; all else is passed over.
_KEYS = r'"(?:pipelineId|type|value)":'
_TOKEN = rf'(?:[^"{{}}\[\]]++|(?!{_KEYS}){_STRING})*+({_KEYS}(?:{_STRING}|[{{\[])?|[{{}}\[\]])'


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def value_at(json: Column, path: str) -> Column:
    """The value at a path as JSON text; null if there is none, or no JSON."""
    return F.to_json(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def json_string(value: Column) -> Column:
    """The text of a JSON string; null for any other value, numbers too."""
    return F.when(value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string"))


def text_or_literal(value: Column) -> Column:
    """A JSON value that is text, or the text of ``{"type": "literal", "value": text}``; else null."""
    literal = F.when(json_string(value_at(value, "$.type")) == "literal", json_string(value_at(value, "$.value")))
    return F.when(value.startswith("{"), literal).otherwise(json_string(value))


def processes(json: Column) -> Column:
    """The processes of a job document, without their ids, each as JSON text; null if it has none."""
    return F.map_values(F.from_json(json, "processes map<string, string>").getField("processes"))


def given_references(json: Column) -> Column:
    """The texts that ``pipelineId`` has at any depth of a document, as text or as ``{"type": "literal", "value": text}``, in order.

    Nothing is looked for below a reference. Null where the text is no JSON. One pass over the document: it is cut into its brackets and the keys that
    matter, and a running depth tells where a reference that is an object ends, and which keys are its own.
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(json)), F.lit(_TOKEN), 1)
    none, text = F.lit(None).cast("string"), F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("inside"), none.alias("kind"), none.alias("value"), text.alias("found"))

    def step(state: Column, token: Column) -> Column:
        depth, inside, kind, value, found = (state.getField(name) for name in ("depth", "inside", "kind", "value", "found"))
        outside = inside < 0
        opens, closes = token.endswith("{") | token.endswith("["), token.isin("}", "]")
        # A text ends in a quote, so only brackets by themselves and openings behind a key are counted.
        deeper = F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth)
        reference, ends = outside & token.startswith('"pipelineId":'), closes & (deeper == inside)
        own = ~outside & (depth == inside + 1)
        given = F.when(reference & token.endswith('"'), F.substr(token, F.lit(14))).when(ends & (kind == '"literal"'), value)
        return F.struct(
            deeper.alias("depth"),
            F.when(reference & opens, depth).when(ends, F.lit(-1)).otherwise(inside).alias("inside"),
            F.when(outside, none).when(own & token.startswith('"type":"'), F.substr(token, F.lit(8))).otherwise(kind).alias("kind"),
            F.when(outside, none).when(own & token.startswith('"value":"'), F.substr(token, F.lit(9))).otherwise(value).alias("value"),
            F.when(given.isNotNull(), F.array_append(found, given)).otherwise(found).alias("found"),
        )

    return F.transform(F.aggregate(tokens, start, step, lambda state: state.getField("found")), json_string)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _texts(holders: Column, wrapped: bool) -> Column:
    """The text that ``pipelineId`` has in each of some objects, or with ``wrapped`` the text of any object's ``value``."""

    def text(value: Column) -> Column:
        return F.when(F.to_json(value).startswith('"'), _at(value, "$", "string"))

    def reference(value: Column) -> Column:
        own = text(value)
        return F.coalesce(own, bind(_at(value, "$.value"), text)) if wrapped else own

    return F.array_compact(F.transform(holders, lambda holder: bind(_at(holder, "$.pipelineId"), reference)))


def process_references(document: Column) -> Column:
    """What a parsed job document (a variant) refers to in its processes, components and, beside components, libraries of requested tasks.

    A process may wrap its text, the others may not. Null for what isn't a job document: without a parsed value, where processes are no object,
    components no array, or where something that should have a reference is no object.
    """
    items, entries = "array<variant>", "map<string, variant>"
    none = F.array().cast(items)

    def lists(value: Column) -> Column:
        return F.coalesce(value, none)

    def held(values: Column, key: str) -> Column:
        return F.array_compact(F.transform(values, lambda value: _at(value, f"$.{key}")))

    processes, components = F.map_values(_at(document, "$.processes", entries)), _at(document, "$.components", items)
    request = F.coalesce(_at(document, "$.request.CreateNewJobRequest"), _at(document, "$.request"))
    tasks = lists(_at(request, "$.tasks", items))
    libraries = F.flatten(F.transform(tasks, lambda task: lists(_at(task, "$.libraries", items))))
    owners = [held(lists(processes), "properties"), held(lists(components), "PipelineComponent")]
    owners.append(F.when(components.isNotNull(), held(libraries, "PipelineComponent")).otherwise(none))
    of_other_kind = [_at(document, "$.processes").isNotNull() & processes.isNull(), _at(document, "$.components").isNotNull() & components.isNull()]

    def found(groups: Column) -> Column:
        every = F.exists(F.flatten(groups), lambda owner: _at(owner, "$", entries).isNull())
        texts = [_texts(F.element_at(groups, i + 1), wrapped=i == 0) for i in range(3)]
        return F.when(~every, F.concat(*texts))

    return F.when(document.isNotNull() & ~(of_other_kind[0] | of_other_kind[1]), bind(F.array(*owners), found))


def document_references(path: Column, json: Column) -> Column:
    """What ``is_stale`` should judge a JSON file by: its references, null for its whole text.

    A workflow document names itself in ``metainfo.uri``, job documents name others in
    their processes. Other JSON files, and text that is no JSON, are judged as a whole. A file is parsed once.
    """
    workflow = path.rlike(r"(^|/)workflow\.latest\.json$")
    judged = path.endswith(".json") & (workflow | path.startswith("jobs/") | path.contains("/jobs/"))

    def found(document: Column) -> Column:
        own = F.array_compact(F.array(_at(document, "$.metainfo.uri", "string")))
        return F.when(workflow, F.when(document.isNotNull(), own)).otherwise(process_references(document))

    return F.when(judged, bind(F.try_parse_json(json), found))


def json_refs(df: DataFrame, json: str) -> DataFrame:
    """Distinct ids of the other projects a set of job documents refers to."""
    references = df.select(F.explode(given_references(F.col(json))).alias("reference"))
    return (
        references.select(reference_fields(F.col("reference")).getField("project_id").alias("project_id"))
        .filter(F.col("project_id").isNotNull())
        .distinct()
    )


def entities_of_kind(df: DataFrame, json: str, kind: str) -> DataFrame:
    """Distinct references of the processes of one component kind."""
    process = df.select(F.explode(processes(F.col(json))).alias("process"))
    return (
        process.filter(json_string(value_at(F.col("process"), "$.component")) == kind)
        .select(text_or_literal(value_at(F.col("process"), "$.properties.pipelineId")).alias("entity"))
        .filter(F.col("entity").isNotNull())
        .distinct()
    )


def entity_places(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """One row per process that has an entity and a place (the size's text before ``/``)."""
    process = df.select(*keys, F.explode(processes(F.col(json))).alias("__process"))
    size = json_string(value_at(F.col("__process"), "$.properties.clusterSize"))
    pairs = process.filter(size != "").select(
        *keys,
        text_or_literal(value_at(F.col("__process"), "$.properties.pipelineId")).alias("entity"),
        F.split_part(size, F.lit("/"), F.lit(1)).alias("place"),
    )
    return pairs.filter(F.col("entity") != "")


def has_component(processes: Column, kind: str) -> Column:
    """Whether any value of a map of processes is of the given component kind."""
    return F.coalesce(F.exists(F.map_values(processes), lambda p: p.getField("component") == kind), F.lit(False))


def rewrite_items(items: Column, when: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """Rewrite the array items that meet a condition, leaving order and other items."""
    return F.transform(items, lambda item: F.when(when(item), then(item)).otherwise(item))


def wheels_to_packages(libraries: Column, index_url: str | None = None) -> Column:
    """Turn wheel files of a library list into package requirements.

    ``libraries`` is an array of structs with at least the fields ``whl`` (text) and
    ``pypi`` (struct of ``package`` and ``repo``). Wheels whose name and version
    cannot be read from the path stay. With ``index_url`` packages come from there.
    """
    def parts(item: Column) -> Column:
        return package_parts(item.getField("whl"))

    def package(item: Column) -> Column:
        repo = f"{index_url.rstrip('/')}/simple" if index_url else None
        requirement = F.concat_ws("==", parts(item).getField("name"), parts(item).getField("version"))
        pypi = F.struct(requirement.alias("package"), F.lit(repo).cast("string").alias("repo"))
        return item.withField("pypi", pypi).withField("whl", F.lit(None).cast("string"))

    return rewrite_items(libraries, lambda item: parts(item).getField("name") != "", package)


def items_allowed(items: Column, allowed: Column) -> Column:
    """The items that are in the allowed array, in order and with duplicates."""
    return F.filter(items, lambda item: F.array_contains(allowed, item))


def components_of_kind(df: DataFrame, items: str, kind: str, drop_empty: bool) -> DataFrame:
    """Replace an array of one-field structs by the values of one kind.

    Rows without any such item are dropped or kept with an empty array.
    """
    chosen = F.transform(
        F.filter(F.col(items), lambda item: item.getField(kind).isNotNull()), lambda item: item.getField(kind)
    )
    out = df.withColumn(items, F.coalesce(chosen, F.array().cast(_chosen_type(df, items, kind))))
    return out.filter(F.size(items) > 0) if drop_empty else out


def _chosen_type(df: DataFrame, items: str, kind: str) -> ArrayType:
    return ArrayType(df.schema[items].dataType.elementType[kind].dataType)


def any_flag(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row: for each name, whether its condition holds in any row (false for no rows)."""
    return df.agg(
        *[F.coalesce(F.bool_or(F.coalesce(flag, F.lit(False))), F.lit(False)).alias(n) for n, flag in flags.items()]
    )


def task_versions(df: DataFrame, components: str, tasks: str, version: Callable[[Column], Column]) -> DataFrame:
    """Distinct (entity, version) pairs: a component's node and a task share a name.

    ``components`` is an array of struct(node, entity), ``tasks`` an array of struct(task_key, files). Both lie in the same row: its
    components and files become rows under (row, name) in one pass, so the work grows with their number and not with
    their product, and what a name has in common is reduced to distinct entities and versions before it is shuffled.
    """
    none = F.lit(None).cast("string")

    def given(column: str) -> Column:
        return F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))

    def files(task: Column) -> Column:
        listed = F.coalesce(task.getField("files"), F.array().cast("array<string>"))
        return F.transform(listed, lambda f: F.struct(task.getField("task_key").alias("name"), none.alias("entity"), f.alias("file")))

    nodes = F.transform(given(components), lambda c: F.struct(c.getField("node").alias("name"), c.getField("entity").alias("entity"), none.alias("file")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.concat(nodes, F.flatten(F.transform(given(tasks), files))).alias("items"))
    items = rows.select("row", F.explode("items").alias("item"))
    named = items.select("row", "item.name", "item.entity", version(F.col("item.file")).alias("version"))
    shared = named.filter((F.col("name") != "") & (F.coalesce(F.col("entity") != "", F.lit(False)) | F.col("version").isNotNull()))
    shared = shared.groupBy("row", "name").agg(F.collect_set("entity").alias("entities"), F.collect_set("version").alias("versions"))
    return shared.select(F.explode("entities").alias("entity"), "versions").select("entity", F.explode("versions").alias("version")).distinct()
