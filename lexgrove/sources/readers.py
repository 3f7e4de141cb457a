"""Readers of page dumps, annotated corpora, tables, shards and dump descriptions, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions.surface import NO_ENTRY

#: The fields of a page dump, of a token table and of a dump description, as their files have them.
PAGE = "title string, ns int, id long, redirect struct<_title: string>, revision struct<id: long, contributor: struct<id: long>, text: struct<_VALUE: string>>"
TOKEN = "Article_ID int, Sentence_ID int, Token_ID int, Token string, POS_Tag string, Chunk_Tag string, NER_Tag string, NER_Tag_ID long, NER_Tag_Normalized string"
#: Fixed values of the corpus files: what opens a document, and the rest of that line in one file or another.
MARK = "-DOCSTART- "
MARK_ENDS = ("-X- O O\n\n", "-X- -X- O\n\n")


def pages(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Pages of an XML dump (plain or bz2): title, ns, id, redirect, text, page_id, revision_id, contributor_id.

    Files whose name has `index` in it are passed over. compat: id is the last one in the page, not the page's."""
    raw = spark.read.format("xml").option("rowTag", "page").option("mode", "PERMISSIVE").schema(PAGE).load(path)
    raw = raw.filter(~F.contains(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit("index")))
    ids = (F.col("revision.contributor.id"), F.col("revision.id"), F.col("id"))
    return raw.select("title", "ns", (F.coalesce(*ids) if compat else F.col("id")).alias("id"), F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"), F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), F.col("revision.contributor.id").alias("contributor_id"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """file, start, doc: what follows each mark, in the order of files and places. Files are split between marks, not read whole;
    what precedes a file's first mark isn't told apart here."""
    records = spark.read.option("lineSep", MARK).text(path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return records.select(*place, F.col("value").alias("doc"))


def _numbered(records: DataFrame, name: str) -> DataFrame:
    """Adds the running number of records (file, start of a split, ...) over all files, from 0. A split's records are read in order by
    one task, so they are counted by split, and only one row for each split is summed up; the records themselves stay where they are.
    The files are read twice."""
    rows = records.withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(F.min("_row").alias("_least"), F.count("*").alias("_n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("file", "start", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(splits), ["file", "start"])
    return out.withColumn(name, F.col("_row") - F.col("_least") + F.col("_before")).drop("_row", "_least", "_before")


def _conll_documents(spark: SparkSession, path: str) -> DataFrame:
    found = _documents(spark, path)
    end = F.when(F.startswith("doc", F.lit(MARK_ENDS[0])), len(MARK_ENDS[0])).when(F.startswith("doc", F.lit(MARK_ENDS[1])), len(MARK_ENDS[1]))
    return found.withColumn("end", end).filter("end is not null").select("file", "start", F.expr("substring(doc, end + 1)").alias("doc"))


def conll(spark: SparkSession, path: str, names: tuple[str, ...] = ("token", "pos", "chunk", "ner")) -> DataFrame:
    """doc_id, sent_id, tok_id and the named columns of CoNLL files; what precedes a file's first mark is dropped.

    Documents are numbered over all files, in the order of their paths."""
    docs = _numbered(_conll_documents(spark, path), "doc_id").select("doc_id", "doc")
    return _token_lines(docs, names)


def chunked_sentences(spark: SparkSession, path: str, names: tuple[str, ...] = ("token", "pos", "chunk")) -> DataFrame:
    """sent_id, tok_id and the named columns of files without document marks: a line for each token, a blank line behind a sentence.
    Sentences are numbered over all files, in the order of their paths."""
    records = spark.read.option("lineSep", "\n\n").text(path).filter("trim(replace(value, '\n', '')) <> ''")
    place = records.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("sentence"))
    return _lines(_numbered(place, "sent_id").select("sent_id", "sentence"), ["sent_id"], names)


def _token_lines(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return _lines(docs.select("doc_id", F.posexplode(F.split("doc", "\n\n")).alias("sent_id", "sentence")), ["doc_id", "sent_id"], names)


def _lines(found: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    lines, parts = F.filter(F.split("sentence", "\n"), lambda x: x != ""), F.split("line", " ")
    return found.select(*keys, F.posexplode(lines).alias("tok_id", "line")).select(*keys, "tok_id", *(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def conll_counts(spark: SparkSession, path: str) -> DataFrame:
    """n_docs, n_sentences, n_with_empty: sentences with tokens, and as blank lines delimit them."""
    parts = _conll_documents(spark, path).select(F.split("doc", "\n\n").alias("s"))
    full = F.size(F.filter("s", lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(""))) != ""))
    return parts.agg(F.count("*").alias("n_docs"), F.sum(full).alias("n_sentences"), F.sum(F.size("s")).alias("n_with_empty"))


def aida_kind(line: Column) -> Column:
    return F.when(line.startswith("-DOCSTART-"), "DOCSTART").when(line == "", "NEWSENTENCE").otherwise("TOKEN")


def aida_header(line: Column) -> tuple[Column, Column]:
    """Document id and name of a line like -DOCSTART- (12testa NAME)."""
    pattern = r"(\d+(?:test[ab])?) (.+)"
    name = F.regexp_extract(line, pattern, 2)
    return F.regexp_extract(line, pattern, 1), name.substr(F.lit(1), F.length(name) - 1)


def aida(spark: SparkSession, path: str) -> DataFrame:
    """The token table of annotated TSV files. A document is one record; its lines are numbered inside it."""
    docs = _documents(spark, path).filter("startswith(doc, '(')").select(F.substring_index("doc", "\n", 1).alias("head"), F.expr("substr(doc, length(substring_index(doc, '\n', 1)) + 1)").alias("rest"))
    doc, name = aida_header(F.concat(F.lit(MARK), F.col("head")))
    # rest starts with the end of the head's line; a line end behind another is an empty line, and the next sentence starts there
    rows = docs.select(doc.alias("doc"), name.alias("name"), F.posexplode(F.split("rest", r"(?<=\n)\n")).alias("sentence", "lines"))
    rows = rows.select("doc", "name", "sentence", F.explode(F.split("lines", "\n")).alias("line")).filter(aida_kind(F.col("line")) == "TOKEN")
    parts = F.split("line", "\t")
    known = F.size(parts) >= 4
    field = lambda i: F.when(known, F.get(parts, F.lit(i)))
    entry = lambda i: F.when(known, F.coalesce(F.get(parts, F.lit(i)), F.lit(NO_ENTRY)))
    columns = {"Document_ID": F.col("doc"), "Document_Name": F.col("name"), "Sentence_Number": F.col("sentence").cast("int"), "Token": parts[0], "BI_Tag": field(1), "Complete_Entity": field(2), "YAGO2_Entity": field(3)}
    columns |= {"Wikipedia_URL": entry(4), "Wikipedia_ID": entry(5), "Freebase_MID": entry(6)}
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV token table; words like NA or null stay words."""
    return spark.read.csv(path, header=True, schema=TOKEN, nullValue="\u0000")


def write_token_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, compression="gzip")  # as its ids and tags are most of a plain one


def shards(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """anchor, entity, n of JSON shards {anchor: {entity: n}}, an object on each line or, with whole_files, one spread over a file's
    lines; counts of the same pair are summed."""
    text = spark.read.text(path, wholetext=whole_files)
    maps = text.select(F.explode(F.from_json("value", "map<string, map<string, bigint>>")).alias("anchor", "entities"))
    return maps.select("anchor", F.explode("entities").alias("entity", "n")).groupBy("anchor", "entity").agg(F.sum("n").alias("n"))


def write_shards(counts: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Shards as `shards` reads them: an object for each anchor, a bounded number of them in a file."""
    by = counts.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("entity", "n"))).alias("entities"))
    lines = by.select(F.to_json(F.map_from_entries(F.array(F.struct("anchor", "entities")))).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def write_pages(found: DataFrame, path: str) -> None:
    """Pages (title, ns, id, redirect, text) as an XML dump that `pages` reads."""
    shaped = found.select("title", "ns", "id", F.when(F.col("redirect").isNotNull(), F.struct(F.col("redirect").alias("_title"))).alias("redirect"), F.struct(F.col("id"), F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"))
    shaped.write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, size of the regular files under a path whose name has neither `index` nor `.DS_Store` in it; contents aren't read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(name.alias("file"), F.col("length").alias("size")).filter(~F.contains("file", F.lit("index")) & ~F.contains("file", F.lit(".DS_Store")))


def settings(spark: SparkSession, path: str) -> dict[str, str | int | float | bool]:
    """The values of a flat `key: value` file. A number of workers of -1 stands for all cores."""
    out: dict[str, str | int | float | bool] = {}
    for row in spark.read.text(path, wholetext=True).collect():  # a file for people, a few lines long
        for line in row["value"].splitlines():
            key, colon, value = line.split("#")[0].partition(":")
            if not colon:
                continue
            value = value.strip().strip("'\"")
            for kind in (int, float):
                try:
                    out[key.strip()] = kind(value)
                    break
                except ValueError:
                    continue
            else:
                out[key.strip()] = value.lower() == "true" if value.lower() in ("true", "false") else value
            if key.strip().endswith("_workers") and out[key.strip()] == -1:
                out[key.strip()] = spark.sparkContext.defaultParallelism
    return out


STATUS = "jobs map<string, struct<status: string, files: map<string, struct<url: string, sha1: string>>>>"


def dump_files(status: DataFrame, job: str = "metacurrentdump") -> DataFrame:
    """date, ready, file, url, sha1 of dump descriptions (date, json)."""
    x = status.select("date", F.from_json("json", STATUS).alias("s")).select("date", F.col("s.jobs")[job].alias("j"))
    return x.select("date", (F.col("j.status") == "done").alias("ready"), F.explode_outer("j.files").alias("file", "f")).select("date", "ready", "file", "f.url", "f.sha1")


def latest_dump(listing: DataFrame) -> DataFrame:
    """The newest dump (date, ready) if it is ready, else the one before; entries that are no dates are passed over."""
    two = listing.filter(F.col("date").rlike("^[0-9]+/?$")).withColumn("d", F.regexp_replace("date", "/", "").cast("int")).orderBy(F.desc("d")).limit(2)
    both = two.agg(F.max(F.struct("d", "ready")).alias("a"), F.min(F.struct("d", "ready")).alias("b"))
    return both.select(F.when(F.col("a.ready"), F.col("a.d")).otherwise(F.col("b.d")).alias("date"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, sha1 of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha1("content").alias("sha1"))
