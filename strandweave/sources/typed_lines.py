"""Typed text lines: a self-describing line format in which each line has a type letter, its fields and one list.

A file begins with ``1 <len> <type> <major> <minor>``; ``~`` lines give the
schema: ``~ O|G|D <letter> <n> (<len> <field kind>)*`` for objects, groups and
data lines.  Lists and strings are written with their length in front.  Objects
are numbered from 1; lines after an object's line belong to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.sources.sequences import text_rows

#: Lines whose objects are counted by one task.
STRETCH = 1 << 16

#: Field kinds by name and the types they are read as.
KINDS = {"INT": "bigint", "REAL": "double", "CHAR": "string", "STRING": "string", "DNA": "string", "INT_LIST": "array<bigint>", "REAL_LIST": "array<double>", "STRING_LIST": "array<string>"}


def read_lines(spark: SparkSession, path: str | list[str], object_type: str = "S") -> DataFrame:
    """(file, line_no, object, line_type, rest, size): all lines below the header.

    object is the number of the last line of ``object_type`` up to there in its
    file, 0 before the first; size is the length of the line's list or 0.  Objects
    are counted within stretches of lines, and only the stretches' sums are added
    up over a file.
    """
    paths = [path] if isinstance(path, str) else path
    kind = F.substring("value", 1, 1)
    rows = text_rows(spark, paths, keep=(F.length("value") > 0) & kind.rlike("^[A-Za-z]$"))
    rows = rows.select("file", F.col("n").alias("line_no"), kind.alias("line_type"), F.expr("substring(value, 3, length(value))").alias("rest"))
    is_object = (F.col("line_type") == object_type).cast("long")
    rows = rows.withColumn("_stretch", F.floor(F.col("line_no") / STRETCH))
    sums = rows.groupBy("file", "_stretch").agg(F.sum(is_object).alias("_n"))
    before = Over.partitionBy("file").orderBy("_stretch").rowsBetween(Over.unboundedPreceding, -1)
    sums = sums.select(F.col("file").alias("_f"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(is_object).over(Over.partitionBy("file", "_stretch").orderBy("line_no"))
    body = rows.withColumn("_inside", inside).join(sums, (F.col("file") == F.col("_f")) & (F.col("_stretch") == F.col("_s")))
    body = body.select("file", "line_no", (F.col("_inside") + F.col("_before")).cast("long").alias("object"), "line_type", "rest")
    schema = {name: fields for kind_, name, fields in read_schema(spark, paths[0]) if kind_ != "!"}
    size = F.lit(0).cast("long")
    for letter, fields in schema.items():
        at = next((i for i, f in enumerate(fields) if f.endswith("LIST") or f in ("STRING", "DNA")), None)
        if at is not None:
            size = F.when(F.col("line_type") == letter, F.get(F.split("rest", " "), F.lit(at)).cast("long")).otherwise(size)
    return body.withColumn("size", size)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The lines in front of the data, as they are."""
    return [r.value for r in text_rows(spark, [path], keep=F.length("value") > 0).where(~F.substring("value", 1, 1).rlike("^[A-Za-z]$")).orderBy("n").toLocalIterator()]


def provenance(spark: SparkSession, path: str) -> tuple[list[tuple], list[tuple]]:
    """(programs, references) of a file's header: (program, version, command, date) and (file, count), to go on with in ``header``."""
    programs, references = [], []
    for line in read_header(spark, path):
        if line.startswith("! "):
            rest, out = line[4:] if line[2:4] == "4 " else line[2:], []
            while rest:
                n, _, rest = rest.partition(" ")
                out.append(rest[: int(n)])
                rest = rest[int(n) + 1 :]
            programs.append(tuple(out))
        elif line.startswith("< "):
            n, _, rest = line[2:].partition(" ")
            references.append((rest[: int(n)], int(rest[int(n) + 1 :])))
    return programs, references


def text_view(spark: SparkSession, path: str, part: str = "all") -> DataFrame:
    """(n, value): a file's lines in order, all, the header's only or the body's only."""
    letter = F.substring("value", 1, 1).rlike("^[A-Za-z]$")
    keep = {"all": F.length("value") > 0, "header": ~letter & (F.length("value") > 0), "body": letter}[part]
    return text_rows(spark, [path], keep=keep).select("n", "value")


def to_parquet(spark: SparkSession, path: str, out: str, object_type: str = "S") -> None:
    """The binary view: each line type's table as Parquet below out, with the header's lines beside them."""
    for _, letter, fields in read_schema(spark, path):
        if fields or letter != object_type:
            table(spark, path, letter, object_type).write.parquet(f"{out}/{letter}")
    spark.createDataFrame([(k, v) for k, v in enumerate(read_header(spark, path))], "n int, value string").coalesce(1).write.parquet(f"{out}/header")


def read_schema(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]]:
    """(O, G or D; letter; field kinds) of each schema line; raises for an unknown kind or two lists in one line."""
    out = []
    for r in spark.read.text(path).where(F.col("value").startswith("~")).collect():
        _, kind, letter, n, *rest = r.value.split()
        fields = rest[1 : 2 * int(n) : 2]
        if any(f not in KINDS for f in fields):
            raise ValueError(f"unknown field: {r.value}")
        if sum(f.endswith("LIST") or f in ("STRING", "DNA") for f in fields) > 1:
            raise ValueError(f"more than one list: {r.value}")
        out.append((kind, letter, fields))
    return out


def check_schema(have: list, want: list) -> None:
    """Raise where letters that both schemas have differ in their fields; others are allowed on either side."""
    known = {letter: fields for _, letter, fields in have}
    for _, letter, fields in want:
        if letter in known and known[letter] != fields:
            raise ValueError(f"line {letter}: {known[letter]} in the file, {fields} expected")


def table(spark: SparkSession, path: str | list[str], letter: str, object_type: str = "S") -> DataFrame:
    """(file, object, line_no, f0, f1, ...): the lines of one type with typed fields."""
    fields = next(f for _, name, f in read_schema(spark, path if isinstance(path, str) else path[0]) if name == letter)
    rows = read_lines(spark, path, object_type).where(F.col("line_type") == letter)
    parts, out = F.split("rest", " "), ["file", "object", "line_no"]
    for i, kind in enumerate(fields):
        if kind in ("STRING", "DNA"):
            head = F.array_join(F.slice(parts, 1, i + 1), " ")
            value = F.expr("substring(rest, length(_head) + 2, _size)")
            rows = rows.withColumn("_head", head).withColumn("_size", F.get(parts, F.lit(i)).cast("int")).withColumn(f"f{i}", value)
        elif kind == "STRING_LIST":
            rows = rows.withColumn(f"f{i}", _string_list(parts, i))
        elif kind.endswith("LIST"):
            rows = rows.withColumn(f"f{i}", F.slice(parts, F.lit(i + 2), F.get(parts, F.lit(i)).cast("int")).cast(KINDS[kind]))
        else:
            rows = rows.withColumn(f"f{i}", F.get(parts, F.lit(i)).cast(KINDS[kind]))
        out.append(f"f{i}")
    return rows.select(*out)


def _string_list(parts, i):
    """Strings that hold no blanks: a count, then length and text of each."""
    n = F.get(parts, F.lit(i)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.get(parts, k * 2 + i))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_in_file, id, desc, len, seq, qual) of files of S lines with I lines for names, Q lines for qualities and N lines for runs of a letter.

    The files of one call have one schema.  An N line puts its letter, read as a
    reader of sequence files takes it, in place of a run of bases.
    """
    schema = {letter: fields for _, letter, fields in read_schema(spark, path if isinstance(path, str) else path[0])}
    # Letters are read as bases one by one, so that places stay what they are.
    base = F.translate(F.translate(F.lower("f0"), "n", "a"), "u", "t")
    out = table(spark, path, "S").select("file", "object", base.alias("seq"))
    here = ["file", "object"]
    if "I" in schema:
        name = F.col("f0")
        named = table(spark, path, "I").groupBy(*here).agg(F.max(name).alias("_i"))
        out = out.join(named, here, "left").withColumn("id", F.regexp_extract("_i", r"^(\S*)", 1)).withColumn("desc", F.regexp_extract("_i", r"^\S*\s+(.*)$", 1)).drop("_i")
    else:
        out = out.withColumn("id", F.lit(None).cast("string")).withColumn("desc", F.lit(None).cast("string"))
    if "Q" in schema:
        scores = F.transform(F.filter(F.split("f0", ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)
        out = out.join(table(spark, path, "Q").select(*here, scores.alias("qual")).groupBy(*here).agg(F.first("qual").alias("qual")), here, "left")
    else:
        out = out.withColumn("qual", F.lit(None).cast("array<int>"))
    if "N" in schema:
        letter = F.translate(F.translate(F.lower("f1"), "n", "a"), "u", "t")
        runs = table(spark, path, "N").groupBy(*here).agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("f0").cast("int").alias("at"), F.col("f2").cast("int").alias("n"), letter.alias("c")))).alias("_runs"))
        out = out.join(runs, here, "left")
        with_runs = F.aggregate(F.coalesce("_runs", F.array()), F.col("seq"), lambda s, r: F.overlay(s, F.repeat(r.c, r.n), r["at"] + 1))
        out = out.withColumn("seq", F.when(F.col("_runs").isNotNull(), with_runs).otherwise(F.col("seq"))).drop("_runs")
    return out.select("file", F.col("object").cast("int").alias("seq_in_file"), "id", "desc", F.length("seq").cast("long").alias("len"), "seq", "qual")


def objects(lines: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The lines of objects numbered in half-open ranges, with what belongs to them; 0 stands for lines before the first object."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | ((F.col("object") >= low) & (F.col("object") < high))
    return lines.where(test)


def lines_until_next(lines: DataFrame, letter: str) -> DataFrame:
    """(object, n): lines of a type in each object."""
    return lines.groupBy("object").agg(F.sum((F.col("line_type") == letter).cast("long")).alias("n"))


def format_lines(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Text lines (value) of rows (line_type, f0, ...) of one type."""
    parts = [F.col("line_type")]
    for i, kind in enumerate(fields):
        c = F.col(f"f{i}")
        if kind in ("STRING", "DNA"):
            parts.append(F.concat_ws(" ", F.length(c).cast("string"), c))
        elif kind == "STRING_LIST":
            parts.append(F.concat_ws(" ", F.size(c).cast("string"), F.array_join(F.transform(c, lambda x: F.concat_ws(" ", F.length(x).cast("string"), x)), " ")))
        elif kind.endswith("LIST"):
            parts.append(F.concat_ws(" ", F.size(c).cast("string"), F.array_join(c.cast("array<string>"), " ")))
        else:
            parts.append(c.cast("string"))
    return rows.select(F.rtrim(F.concat_ws(" ", *parts)).alias("value"))


def header(file_type: str, schema: list[tuple[str, str, list[str]]], provenance: list[tuple[str, str, str, str]] = (), references: list[tuple[str, int]] = ()) -> list[str]:
    """The lines in front of the data."""
    out = [f"1 {len(file_type)} {file_type} 1 0"]
    out += [" ".join(["~", kind, letter, str(len(fields)), *(f"{len(f)} {f}" for f in fields)]) for kind, letter, fields in schema]
    out += [" ".join(["!", "4", *(f"{len(x)} {x}" for x in p)]) for p in provenance]
    out += [f"< {len(name)} {name} {n}" for name, n in references]
    return out


def write_sequences(seqs: DataFrame, path: str, file_type: str = "seq", programs: list[tuple] = (), references: list[tuple] = ()) -> None:
    """seqs (id, seq; qual if there) as a folder of parts that follow each other by name, of S, I and Q lines in order of seq_ord if there is one.

    Parts are written in parallel; the first begins with the header, with the
    programs and references that the sequences come from.
    """
    has_qual = "qual" in seqs.columns
    schema = [("O", "S", ["DNA"]), ("D", "I", ["STRING"])] + [("D", "Q", ["STRING"])] * has_qual
    ordered = seqs.repartitionByRange("seq_ord").sortWithinPartitions("seq_ord") if "seq_ord" in seqs.columns else seqs
    line = lambda letter, text: F.concat_ws(" ", F.lit(letter), F.length(text).cast("string"), text)
    parts = [line("S", F.col("seq")), line("I", F.coalesce(F.col("id").cast("string"), F.lit("")))]
    if has_qual:
        text = F.array_join(F.transform("qual", lambda q: F.char((q + 33).cast("int"))), "")
        parts.append(F.when(F.col("qual").isNotNull(), line("Q", text)))
    lines = ordered.select(F.array_join(F.array_compact(F.array(*parts)), "\n").alias("value"))
    top = seqs.sparkSession.createDataFrame([(line_,) for line_ in header(file_type, schema, programs, references)], "value string").coalesce(1)
    top.unionByName(lines).write.text(path)
