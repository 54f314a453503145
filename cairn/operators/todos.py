"""Task lists in Markdown: '- [ ] task (id: …, due: …, priority: …, tags: a, b)' under '## Project' headers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The file format's lines.
LINE = r"^\s*-\s+\[([ x])\]\s+(.+?)(?:\s+\((.+?)\))?\s*$"
HEADER = r"^##\s+(.+)$"


def field(meta: Column, name: str) -> Column:
    """The value of a key, up to the next key; null if empty."""
    value = F.regexp_extract(meta, rf"(?:^|,\s*){name}:\s*(.*?)\s*(?:,\s*\w+:|$)", 1)
    return F.nullif(F.trim(value), F.lit(""))


def parse(lines: DataFrame) -> DataFrame:
    """Todos of lines (line_no, line[, file]); a header holds until the next, before the first is 'General'.

    A task without an id gets one from its project, text and place.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    header = F.nullif(F.trim(F.regexp_extract("line", HEADER, 1)), F.lit(""))
    carried = F.last(header, True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("project", F.coalesce(carried, F.lit("General"))).filter(F.col("line").rlike(LINE))
    meta = F.regexp_extract("line", LINE, 3)
    task = F.trim(F.regexp_extract("line", LINE, 2))
    tags = F.filter(F.transform(F.split(F.coalesce(field(meta, "tags"), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    ident = F.coalesce(field(meta, "id"), F.substring(F.sha2(F.concat_ws("|", "project", task, F.col("line_no").cast("string")), 256), 1, 8))
    status = F.when(F.regexp_extract("line", LINE, 1) == "x", "completed").otherwise("pending")
    return rows.select(ident.alias("id"), task.alias("task"), status.alias("status"), field(meta, "due").alias("due"), field(meta, "priority").alias("priority"), tags.alias("tags"), "project", F.col("line_no").cast("int").alias("ordinal"))


def is_blocked() -> Column:
    return F.lower("task").rlike("block(ed|ing)") | F.array_contains(F.transform("tags", F.lower), "blocked")


def is_overdue(today: str) -> Column:
    return (F.col("status") == "pending") & (F.col("due") < today)


def text_score(query: str) -> Column:
    """2 for the task, 1 for each tag, 1 for the project that contains the text."""
    q = query.lower()
    inside = lambda c: F.lower(c).contains(q).cast("int")
    return 2 * inside(F.col("task")) + F.size(F.filter("tags", lambda t: F.lower(t).contains(q))) + inside(F.col("project"))


def select(todos: DataFrame, today: str, project: str | None = None, status: str | None = None, overdue: bool = False, blocked: bool = False, search: str | None = None, priority: str | None = None) -> DataFrame:
    rows = todos
    for column, value in (("project", project), ("status", status), ("priority", priority)):
        rows = rows if value is None else rows.filter(F.lower(column) == value.lower())
    rows = rows.filter(is_overdue(today)) if overdue else rows
    rows = rows.filter(is_blocked()) if blocked else rows
    if search:
        return rows.withColumn("score", text_score(search)).filter("score > 0").orderBy(F.desc("score"), "project", "ordinal", "id")
    return rows.orderBy("project", "ordinal", "id")


def stats(todos: DataFrame, today: str) -> DataFrame:
    """Counts of all (project null) and of each project, in one pass."""
    sets = todos.select("*").groupingSets([[], ["project"]], "project") if hasattr(todos, "groupingSets") else todos.rollup("project")
    done = F.col("status") == "completed"
    return sets.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"), F.count_if(is_overdue(today)).alias("overdue"),
        F.count_if(is_blocked()).alias("blocked"), F.count_if(F.col("due").isNotNull()).alias("with_due"), F.round(F.count_if(done) / F.count("*"), 4).alias("completion_rate"),
    )


def by_priority(todos: DataFrame) -> DataFrame:
    return todos.groupBy(F.coalesce("priority", F.lit("none")).alias("priority")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))


def tag_counts(todos: DataFrame) -> DataFrame:
    return todos.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("total"))


def render_line() -> Column:
    part = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + ": "), value))
    meta = F.concat_ws(", ", part("id", F.col("id")), part("due", F.col("due")), part("priority", F.col("priority")), part("tags", F.array_join("tags", ", ")))
    return F.concat(F.lit("- ["), F.when(F.col("status") == "completed", "x").otherwise(" "), F.lit("] "), F.col("task"), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""))


def render_projects(todos: DataFrame) -> DataFrame:
    """(project, text): the section of each project that has tasks."""
    lines = todos.withColumn("text", render_line())
    return lines.groupBy("project").agg(F.concat(F.lit("## "), F.first("project"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n"), F.lit("\n")).alias("text"))


def render_header(todos: DataFrame, today: str) -> DataFrame:
    """The file's frontmatter."""
    done = F.count_if(F.col("status") == "completed")
    return todos.agg(F.format_string("---\nlast_synced: %s\ntotal: %d\ncompleted: %d\npending: %d\n---\n", F.lit(today), F.count("*"), done, F.count("*") - done).alias("text"))


def render_file(todos: DataFrame, today: str) -> DataFrame:
    """The whole file as one row (a task list is edited by people and small)."""
    sections = render_projects(todos).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("project", "text"))), lambda s: s["text"]), "\n").alias("sections"))
    return render_header(todos, today).crossJoin(sections).select(F.concat("text", F.lit("\n# Todos\n\n"), "sections").alias("content"))


def default_file(today: str) -> str:
    """Fixed value: the file format's empty file."""
    return f"---\nlast_synced: {today}\ntotal: 0\ncompleted: 0\npending: 0\n---\n\n# Todos\n\n## General\n\n"


def _first(todos: DataFrame, ident: str) -> Column:
    return F.col("id") == ident


def add(todos: DataFrame, task: str, project: str = "General", due: str | None = None, priority: str | None = None, tags: list[str] | None = None) -> DataFrame:
    spark = todos.sparkSession
    after = todos.filter(F.col("project") == project).agg((F.coalesce(F.max("ordinal"), F.lit(0)) + 1).alias("ordinal"))
    new = after.select(F.lit(task).alias("task"), F.lit("pending").alias("status"), F.lit(due).cast("string").alias("due"), F.lit(priority).cast("string").alias("priority"), F.array(*map(F.lit, tags or [])).cast("array<string>").alias("tags"), F.lit(project).alias("project"), F.col("ordinal").cast("int").alias("ordinal"))
    new = new.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "project", "task", F.col("ordinal").cast("string")), 256), 1, 8))
    return todos.unionByName(new.select(*todos.columns))


def update(todos: DataFrame, ident: str, **changes) -> DataFrame:
    for column, value in changes.items():
        new = F.array(*map(F.lit, value)).cast("array<string>") if column == "tags" else F.lit(value)
        todos = todos.withColumn(column, F.when(_first(todos, ident), new).otherwise(F.col(column)))
    return todos


def complete(todos: DataFrame, ident: str) -> DataFrame:
    return update(todos, ident, status="completed")


def delete(todos: DataFrame, ident: str) -> DataFrame:
    return todos.filter(~_first(todos, ident))


def estimate_completion(todos: DataFrame, today: str, days: int = 30) -> DataFrame:
    """(project, pending, estimate): today plus pending / (completed / total) days; plus ``days`` if none is completed; null if none is pending."""
    done = F.count_if(F.col("status") == "completed")
    rows = todos.groupBy("project").agg((F.count("*") - done).alias("pending"), done.alias("completed"), F.count("*").alias("total"))
    ahead = F.when(F.col("completed") == 0, F.lit(days)).otherwise((F.col("pending") / (F.col("completed") / F.col("total"))).cast("int"))
    date = F.date_add(F.to_date(F.lit(today)), ahead).cast("string")
    # Years of more than four digits are cast with a plus sign, which ISO text doesn't have elsewhere.
    return rows.select("project", "pending", F.when(F.col("pending") > 0, F.ltrim(date, F.lit("+"))).alias("estimate"))


def notes_of_todos(todos: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, path): notes whose title holds a tag, or whose title is held by the task.

    Titles are looked up by the task's word sequences, not pair by pair.
    """
    from cairn.functions.text import title_of_path, words

    titles = notes.select("path", F.lower(title_of_path(F.col("path"))).alias("title")).filter("title <> ''")
    longest = titles.agg(F.coalesce(F.max(F.size(words(F.col("title")))), F.lit(1)).alias("n")).head().n
    w = words(F.lower("task"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(int(longest))), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: i + n <= F.size(w)), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))
    probes = todos.select("id", F.explode(F.array_distinct(F.concat(spans, F.transform("tags", F.lower)))).alias("title"))
    return probes.join(titles, "title").select("id", "path").distinct()


def valid_priority(answer: Column) -> Column:
    """A model's answer, or medium."""
    found = F.lower(F.regexp_extract(answer, r"(?i)\b(high|medium|low)\b", 1))
    return F.when(found != "", found).otherwise("medium")


def valid_date(answer: Column, today: str) -> Column:
    """A model's date, or a week from today."""
    found = F.regexp_extract(answer, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(F.try_to_date(found).isNotNull() & (found != ""), found).otherwise(F.date_add(F.to_date(F.lit(today)), 7).cast("string"))


def valid_split(answer: Column, task: Column) -> Column:
    """A model's list of parts (JSON), or the task itself."""
    parts = F.filter(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<string>"), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(task))


def add_from_text(todos: DataFrame, text: str, answer, today: str, project: str = "General") -> DataFrame:
    """Todos with those that a model makes of a plain text: parts, priority and due date.  answer: Column -> Column."""
    asked = lambda what: answer(F.lit(f"{what} of this task: {text}"))
    after = todos.filter(F.col("project") == project).agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("last"))
    made = after.select("last", valid_priority(asked("Priority (high, medium, low)")).alias("priority"), valid_date(asked("Due date (YYYY-MM-DD)"), today).alias("due"), F.posexplode(valid_split(asked("Parts (JSON list)"), F.lit(text))).alias("at", "task"))
    new = made.withColumns({"status": F.lit("pending"), "tags": F.array().cast("array<string>"), "project": F.lit(project), "ordinal": (F.col("last") + F.col("at") + 1).cast("int")})
    new = new.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "project", "task", F.col("ordinal").cast("string")), 256), 1, 8))
    return todos.unionByName(new.select(*todos.columns))


def overdue_summary(todos: DataFrame, today: str, answer) -> DataFrame:
    """One row: the number of overdue todos, and what a model says of them (a task list is edited by people and small)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("due", "task"))), lambda s: F.concat(s["due"], F.lit(" "), s["task"]))
    late = todos.filter(is_overdue(today)).agg(F.count("*").alias("overdue"), F.array_join(lines, "\n").alias("lines"))
    return late.select("overdue", F.when(F.col("overdue") == 0, "nothing is overdue").otherwise(answer(F.concat(F.lit("Overdue tasks:\n"), "lines"))).alias("summary"))


def ask(todos: DataFrame, question: str, today: str, answer) -> DataFrame:
    """A model's answer to a question about the whole list."""
    return render_file(todos, today).select(answer(F.concat(F.lit(question + "\n\n"), "content")).alias("answer"))
