"""Prompt catalogs.

Catalogs are tiny configuration tables (tens of rows).  They are built from
driver-side dicts or read from a JSON file; a catalog is broadcast only after
its size in bytes is checked against ``BROADCAST_BYTES``, otherwise the lookup is
an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import excerpt, strip_ws

BROADCAST_BYTES = 8 << 20  # a prompt catalog is far below this


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configuration table as a SQL ``VALUES`` relation: built and
    planned in the JVM (a local relation), no Python worker, one call."""
    from corpusflow.operators.segment import sql_literal

    names = [f.strip().split()[0] for f in schema.split(",")]
    types = [f.strip().split()[1] for f in schema.split(",")]

    def v(x, t):
        if x is None:
            return f"CAST(NULL AS {t})"
        return sql_literal(x) if isinstance(x, str) else f"CAST({x} AS {t})"

    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(v(x, t) for x, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def task_table(spark: SparkSession, tasks: dict[str, str], origin: str = "default") -> DataFrame:
    rows = [(i, name, prompt, origin) for i, (name, prompt) in enumerate(tasks.items())]
    return local_table(spark, rows, "pos int, task string, prompt string, origin string")


def read_task_file(spark: SparkSession, path: str) -> DataFrame:
    """A saved-task JSON file (one object ``{name: prompt}``) as catalog rows."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.posexplode(F.from_json("value", "map<string,string>"))
    return raw.select(entries.alias("pos", "task", "prompt")).select(
        F.col("pos").cast("int").alias("pos"), "task", "prompt", F.lit("saved").alias("origin"))


def resolve_tasks(spark: SparkSession, defaults: dict[str, str] | None = None,
                  overrides: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Defaults overlaid by saved tasks of the same name; new names appended.

    Full outer join on the name; the prompt is ``coalesce(saved, default)``;
    ``is_default`` tells whether the name exists among the defaults.
    """
    d = task_table(spark, K.DEFAULT_TASKS if defaults is None else defaults, "default")
    if overrides is None:
        overrides = K.SHIPPED_TASKS
    o = task_table(spark, overrides, "saved") if isinstance(overrides, dict) else overrides
    # a name saved twice counts once, with its last prompt
    o = o.groupBy("task").agg(F.max_by("prompt", "pos").alias("prompt"), F.max("pos").alias("pos"))
    j = d.alias("d").join(o.alias("o"), F.col("d.task") == F.col("o.task"), "full_outer")
    out = j.select(
        F.coalesce("d.task", "o.task").alias("task"),
        F.coalesce("o.prompt", "d.prompt").alias("prompt"),
        F.col("d.task").isNotNull().alias("is_default"),
        # defaults keep their place; new names follow in file order
        F.when(F.col("d.pos").isNotNull(), F.col("d.pos")).otherwise(F.lit(10_000) + F.col("o.pos")).alias("pos"),
    )
    return out


def _maybe_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only what was measured: the bytes of all its text columns."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema.fields if f.dataType.simpleString() == "string"]
    size = small.agg(F.coalesce(F.sum(sum(text, F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= limit else small


def attach_task(df: DataFrame, tasks: DataFrame, name: str | None = None, task_col: str | None = None,
                out: str = "prompt") -> DataFrame:
    """Attach the prompt of a task to every row.

    ``name``: one task for all rows; unknown or empty -> ``ValueError``.
    ``task_col``: per-row task names; a row with an unknown task makes the job
    that reads the result fail with that name (one pass over the rows).
    """
    cat = tasks.select("task", F.col("prompt").alias(out)).filter(F.length(F.coalesce(strip_ws(out), F.lit(""))) > 0)
    if name is not None:
        one = cat.filter(F.col("task") == name).limit(1).collect()
        if not one:
            raise ValueError(f"unknown or empty task: {name!r}")
        return df.select(F.lit(name).alias("task"), *[c for c in df.columns if c not in ("task", out)], F.lit(one[0][out]).alias(out))
    if task_col is None:
        raise ValueError("give a task name or a task column")
    small = _maybe_broadcast(cat.select(F.col("task").alias("_task"), F.col(out).alias("_found")))
    joined = df.join(small, df[task_col] == F.col("_task"), "left")
    refuse = F.raise_error(F.concat(F.lit("unknown or empty task: "), F.coalesce(F.col(task_col), F.lit("null"))))
    prompt = F.when(F.col("_found").isNull(), refuse.cast("string")).otherwise(F.col("_found"))
    return joined.select(task_col, *[c for c in df.columns if c not in (task_col, out)], prompt.alias(out))


# --- reverse-prompt catalog (P4, P5) ------------------------------------------------

def reverse_table(spark: SparkSession, custom: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Predefined (rank 0) and custom (rank 1) reverse prompts, with positions."""
    rows = []
    for rank, catalog in ((0, K.PREDEFINED_REVERSE_PROMPTS), (1, custom or {})):
        for t_pos, (ttype, cats) in enumerate(catalog.items()):
            for c_pos, (cat, prompt) in enumerate(cats.items()):
                rows.append((ttype, cat, prompt, rank, t_pos, c_pos))
    return local_table(
        spark, rows, "task_type string, category string, prompt string, rank int, type_pos int, cat_pos int")


def resolve_reverse_prompts(catalog: DataFrame) -> DataFrame:
    """One prompt per (task_type, category): predefined first, custom of the
    same name is shadowed, and its ``lines`` (P6 alternatives) split here, once per
    prompt.  Missing pairs resolve to "" at lookup time."""
    w = Window.partitionBy("task_type", "category").orderBy("rank", "cat_pos")
    out = catalog.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return out.withColumn("lines", template_lines("prompt"))


def lookup_reverse_prompt(df: DataFrame, resolved: DataFrame, type_col: str = "task_type",
                          cat_col: str = "category", out: str = "reverse_prompt") -> DataFrame:
    """P4 as a join: prompt for each row's (task_type, category), else ""."""
    small = resolved.select(F.col("task_type").alias(type_col), F.col("category").alias(cat_col),
                            F.col("prompt").alias(out), F.col("lines").alias(f"{out}_lines"))
    joined = df.join(_maybe_broadcast(small), [type_col, cat_col], "left")
    return joined.withColumn(out, F.coalesce(out, F.lit("")))


def list_categories(resolved_or_catalog: DataFrame, task_type: str) -> DataFrame:
    """P5: categories of a task type, predefined first then custom, in order."""
    return (resolved_or_catalog.filter(F.col("task_type") == task_type)
            .orderBy("rank", "cat_pos").select("category", "rank"))


def describe_templates(catalog: DataFrame, task_type: str) -> DataFrame:
    """P5 listing: ``• category: first 80 characters...`` for the predefined
    prompts of a type (the dots are always added)."""
    pre = catalog.filter((F.col("task_type") == task_type) & (F.col("rank") == 0))
    line = F.concat(F.lit("• "), F.col("category"), F.lit(": "),
                    excerpt("prompt", K.EXCERPT_LISTING, dots=False), F.lit("..."))
    return pre.orderBy("cat_pos").select("category", line.alias("line"))


# --- P6 ---------------------------------------------------------------------------

def template_lines(prompt) -> Column:
    """Non-blank stripped lines of a prompt: the alternatives of P6."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    lines = F.transform(F.split(prompt, "\n", -1), lambda x: strip_ws(x))
    return F.filter(lines, lambda x: F.length(x) > 0)


def seeded_index(seed: str, key=None) -> Column:
    """A uniform, seeded, recomputation-stable hash: the first 32 bits of
    md5(seed[|key]).  md5 is chosen because every SQL engine has it."""
    s = F.lit(str(seed))
    if key is not None:
        k = F.col(key) if isinstance(key, str) else key
        s = F.concat(s, F.lit("|"), k.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def pick_template(prompt, seed: str = "0", key=None) -> Column:
    """One of the non-blank lines of ``prompt``; "" when the prompt is empty;
    the prompt itself when it has no non-blank line.  ``key`` null -> one pick
    per run (same for all rows); a key column -> one pick per row."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    lines = template_lines(prompt)
    idx = F.pmod(seeded_index(seed, key), F.greatest(F.size(lines), F.lit(1))) + 1
    return (F.when(F.coalesce(prompt, F.lit("")) == "", F.lit(""))
            .when(F.size(lines) == 0, prompt)
            .otherwise(F.element_at(lines, idx.cast("int"))))


def with_template(df: DataFrame, prompt: str, seed: str = "0", key=None, out: str = "template") -> DataFrame:
    """P6 on the output of :func:`lookup_reverse_prompt`: one of the prompt's lines,
    split on the catalog side, is picked per row (see :func:`pick_template`)."""
    lines, p = F.col(f"{prompt}_lines"), F.col(prompt)
    idx = F.pmod(seeded_index(seed, key), F.greatest(F.size(lines), F.lit(1))) + 1
    pick = (F.when(F.coalesce(p, F.lit("")) == "", F.lit(""))
            .when(F.size(lines) == 0, p)
            .otherwise(F.element_at(lines, idx.cast("int"))))
    return df.select(*[c for c in df.columns if c != f"{prompt}_lines"], pick.alias(out))
