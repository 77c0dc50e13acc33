"""Reading sequence files: FASTA, FASTQ, SAM text, lists of files, k-mer lists.

Files are split by Spark's text source, also compressed ones; the kind is taken
from the first character.  Letters that are no bases are dropped and n is read
as a, in every format alike.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.functions import dna


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta', 'fastq', 'sam', 'typed', 'packed' or 'list', from the first characters of a file."""
    named = sorted(spark.read.text(path).inputFiles())  # of a folder, the first file by name
    first = spark.read.text(unquote(named[0])).first() if named else None
    line = first.value if first else ""
    if line.startswith(">"):
        return "fasta"
    if line.startswith("@"):
        return "sam" if line[1:4] in ("HD\t", "SQ\t", "RG\t", "PG\t", "CO\t") else "fastq"
    if line.startswith("1 "):
        return "typed"
    return "packed" if line.startswith("b") and "\x00" in line else "list"


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as file metadata show it, with one slash behind the scheme."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri().toString()
    return _one_slash(whole)


def _one_slash(uri: str) -> str:
    scheme, colon, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else uri


def text_rows(spark: SparkSession, paths: list[str], sep: str | None = None, keep=None) -> DataFrame:
    """(file, n, value): lines of files, or what stands between ``sep``; file is the path's number in the list, from 1, n the line's in its file, from 0.

    A path may be a folder, whose files follow by name.  Lines are numbered by
    adding up the numbers of lines of a file's blocks, one small row each, so no
    line is moved.  Lines for which ``keep`` does not hold are not counted.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    where, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = reader.text(paths).select("value", F.regexp_replace(where, "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("_path"), block.alias("_block"))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    # One row for each block that the driver has planned to read: small enough to be sent to all tasks.
    blocks = rows.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    named = spark.createDataFrame([(_qualified(spark, p), k) for k, p in reversed(list(enumerate(paths, 1)))], "_name string, file int")
    inside = blocks.join(named, (F.col("_path") == F.col("_name")) | F.col("_path").startswith(F.concat("_name", F.lit("/"))))
    before = Over.partitionBy("file").orderBy("_path", "_block").rowsBetween(Over.unboundedPreceding, -1)
    offsets = inside.select("file", F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(offsets), (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return out.select("file", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("n"), "value")


def read_fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, seq_in_file, id, desc, len, seq): records are the splits at line starts with >, so large files are read in parallel."""
    paths = [paths] if isinstance(paths, str) else paths
    rows = text_rows(spark, paths, "\n>", F.length(F.trim(F.regexp_replace("value", "^>", ""))) > 0)
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "")
    body = F.when(F.instr(record, "\n") > 0, F.expr("substring(_record, instr(_record, '\n') + 1, length(_record))")).otherwise("")
    rows = rows.withColumn("_record", record).withColumn("_head", head).withColumn("seq", dna.clean(body))
    return rows.select("file", (F.col("n") + 1).cast("int").alias("seq_in_file"), F.regexp_extract("_head", r"^(\S*)", 1).alias("id"), F.regexp_extract("_head", r"^\S*\s+(.*)$", 1).alias("desc"), F.length("seq").cast("long").alias("len"), "seq")


def read_fastq(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, seq_in_file, id, desc, len, seq, qual): records of four lines; raises where sequence and quality differ in length.

    Blank lines at a file's end are no record.
    """
    paths = [paths] if isinstance(paths, str) else paths
    rows = text_rows(spark, paths).withColumn("seq_in_file", F.floor(F.col("n") / 4).cast("int") + 1)
    line = lambda k: F.max(F.when(F.pmod("n", F.lit(4)) == k, F.regexp_replace("value", "\r$", "")))
    rows = rows.groupBy("file", "seq_in_file").agg(line(0).alias("_head"), line(1).alias("_seq"), line(2).alias("_plus"), line(3).alias("_qual"))
    rows = rows.where(F.length(F.trim(F.concat_ws("", "_head", "_seq", "_plus", "_qual"))) > 0)
    sound = F.col("_head").startswith("@") & F.col("_plus").startswith("+") & (F.length("_seq") == F.length("_qual"))
    broken = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("_head", F.lit(""))))
    letters = F.filter(F.split("_seq", ""), lambda x: x != "")
    both = F.arrays_zip(letters.alias("b"), F.transform(F.filter(F.split("_qual", ""), lambda x: x != ""), lambda x: F.ascii(x) - 33).alias("q"))
    good = F.filter(both, lambda x: x.b.rlike("[ACGTNacgtn]"))
    rows = rows.withColumn("_good", F.when(F.coalesce(sound, F.lit(False)), good).otherwise(broken))
    seq = dna.clean(F.col("_seq"))
    return rows.select(
        "file", "seq_in_file", F.regexp_extract("_head", r"^@(\S*)", 1).alias("id"), F.regexp_extract("_head", r"^@\S*\s+(.*)$", 1).alias("desc"),
        F.length(seq).cast("long").alias("len"), seq.alias("seq"), F.transform("_good", lambda x: x.q).alias("qual"),
    )


def read_sam(spark: SparkSession, paths: list[str] | str, as_sequenced: bool = False) -> DataFrame:
    """(file, seq_in_file, id, len, seq, qual) of SAM text as it is there, or as sequenced: reads of the reverse strand turned back."""
    paths = [paths] if isinstance(paths, str) else paths
    rows = text_rows(spark, paths, keep=~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    back = (f[1].cast("int").bitwiseAND(F.lit(16)) != 0) & F.lit(as_sequenced)
    seq = dna.clean(F.when(f[9] == "*", "").otherwise(f[9]))
    qual = F.transform(F.filter(F.split(F.when(f[10] == "*", "").otherwise(f[10]), ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)
    return rows.select(
        "file", (F.col("n") + 1).cast("int").alias("seq_in_file"), f[0].alias("id"), F.length(seq).cast("long").alias("len"),
        F.when(back, dna.reverse_complement(seq)).otherwise(seq).alias("seq"), F.when(back, F.reverse(qual)).otherwise(qual).alias("qual"),
    )


#: Kinds by the ends of names, also with .gz behind.
EXTENSIONS = {".fa": "fasta", ".fasta": "fasta", ".fna": "fasta", ".fq": "fastq", ".fastq": "fastq", ".sam": "sam", ".1seq": "typed", ".2bs": "packed"}


def kind_of(spark: SparkSession, path: str) -> str:
    """A file's kind by its name, or else by its first characters."""
    name = path.rstrip("/").removesuffix(".gz")
    return next((k for e, k in EXTENSIONS.items() if name.endswith(e)), None) or sniff(spark, path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, seq_in_file, id, len, seq) of files of any kinds: one read for each kind, however long the list; names without a telling end are looked at."""
    from strandweave.sources import packed, typed_lines

    by_kind: dict[str, list[int]] = {}
    for k, path in enumerate(paths, 1):
        by_kind.setdefault(kind_of(spark, path), []).append(k)
    readers = {"fasta": read_fasta, "fastq": read_fastq, "sam": read_sam, "typed": typed_lines.read_sequences, "packed": packed.read_packed}
    out = None
    for kind, numbers in sorted(by_kind.items()):
        if kind == "list":
            raise ValueError(f"no sequence file: {paths[numbers[0] - 1]}")
        held = readers[kind](spark, [paths[k - 1] for k in numbers])
        number = F.array(*[F.lit(k) for k in numbers]) if len(numbers) < 100 else None
        if number is not None:
            held = held.withColumn("file", F.element_at(number, F.col("file")))
        else:
            named = spark.createDataFrame(list(enumerate(numbers, 1)), "_k int, _file int")
            held = held.join(F.broadcast(named), F.col("file") == F.col("_k")).withColumn("file", F.col("_file"))
        held = held.select("file", "seq_in_file", "id", "len", "seq")
        out = held if out is None else out.unionByName(held)
    return out


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file of any kind as (file, seq_in_file, id, len, seq); a list of files is read in its order."""
    if kind_of(spark, path) != "list":
        return read_files(spark, [path])
    named = [r.value.strip() for r in text_rows(spark, [path]).orderBy("n").toLocalIterator() if r.value.strip()]
    if not named:
        raise ValueError(f"no files in the list {path}")
    return read_files(spark, named)


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, kmer) of lines ``id kmer``."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("id"), F.get(parts, F.lit(1)).alias("kmer"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """One text row (value) for each record of seqs (id, seq)."""
    return seqs.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(seqs: DataFrame, path: str, compression: str | None = None) -> None:
    fasta_lines(seqs).write.text(path, compression=compression)


def write_fastq(seqs: DataFrame, path: str, compression: str | None = None) -> None:
    """seqs has (id, seq, qual)."""
    qual = F.array_join(F.transform("qual", lambda q: F.char((q + 33).cast("int"))), "")
    seqs.select(F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), qual).alias("value")).write.text(path, compression=compression)


def write_kmer_fasta(nodes: DataFrame, path: str) -> None:
    """Nodes (node, canon as text) as gzipped FASTA with the node's number as id."""
    write_fasta(nodes.select(F.col("node").alias("id"), F.col("canon").alias("seq")), path, "gzip")


def write_any(seqs: DataFrame, path: str, threshold: int = 0) -> None:
    """seqs (id, seq, and qual for FASTQ) in the format that the path's end names, compressed if .gz follows."""
    from strandweave.sources import packed, typed_lines

    name, compression = path.removesuffix(".gz"), "gzip" if path.endswith(".gz") else None
    kind = next((k for e, k in EXTENSIONS.items() if name.endswith(e)), "fasta")
    if kind == "fastq":
        write_fastq(seqs, path, compression)
    elif kind == "typed":
        typed_lines.write_sequences(seqs, path)
    elif kind == "packed":
        packed.write_packed(seqs, path, threshold)
    elif kind == "fasta":
        write_fasta(seqs, path, compression)
    else:
        raise ValueError(f"can't write {kind}")
