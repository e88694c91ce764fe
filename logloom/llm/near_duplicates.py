"""Near-duplicate documents and lines, over the exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise
from .setjoin import Join, lines, similar_sets


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: id_col, n_shingles long, component_id long.

    A document's set are the distinct k-word shingles of its words (A-Z lower-cased runs of bytes
    other than 9-13 and 32), or the whole sequence if it has fewer words. Two documents link when
    100 * intersection >= percent * union; component_id is the least id reachable by links. A null
    text, an empty one, and one without words have no set and link with nothing. A row with a null
    id has a null component and n_shingles 0. Repeated rows are one document; rows of one id with
    different texts link as the texts do, under that id. Texts are read whole whatever their
    length; an empty table gives an empty result; other columns are ignored.
    """
    found = similar_sets(docs, Join(k, percent), "components", id_col, text_col)
    roots = found.classes.join(found.linked, "first", "left").select("sig1", "sig2", F.coalesce("root.doc", "first.doc").alias("root"))
    units = found.units.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "sig1", "sig2")
    out = units.join(roots, ["sig1", "sig2"], "left").select(id_col, "n_shingles", F.coalesce("root", id_col).alias("component_id"))
    none = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(none)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep_repeats: bool = True) -> DataFrame:
    """The rows of docs, all columns as they are, of the first document of each component: by id,
    then by a digest of the text, so that of one id's different texts each is judged by itself.
    Rows without id are kept; documents without words are kept. Rows repeated with the same id and
    text are one document, whose rows all stay, or with keep_repeats=False only one of them."""
    keep, digest, row = (free_name(docs, x) for x in ("keep", "digest", "row"))
    ident = F.col(id_col).cast("long")
    named = docs.where(F.col(id_col).isNotNull())
    if named.groupBy(ident).count().where("count > 1").isEmpty():
        found = ngram_components(docs, k, percent, id_col, text_col)
        kept = found.where((F.col(id_col) == F.col("component_id")) & F.col(id_col).isNotNull()).select(F.col(id_col).alias(keep)).distinct()
        rows = docs.join(kept, docs[id_col].cast("long") == kept[keep]).drop(keep)
        return rows.union(docs.where(F.col(id_col).isNull()))
    whole = F.struct(*docs.columns)
    marked = named.select(ident.alias(keep), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias(digest), whole.alias(row))
    single = marked.groupBy(keep, digest).agg(F.min_by(row, F.to_json(row)).alias(row))
    # numbers that rise with id and digest stand for the ids
    ordered = single.repartitionByRange(keep, digest).sortWithinPartitions(keep, digest)
    numbered = materialise(ordered.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = ngram_components(numbered.select("number", F.col(row)[text_col].alias("text")), k, percent, "number", "text")
    roots = numbered.join(found.where("number = component_id").select("number"), "number")
    rows = marked.join(roots.select(keep, digest), [keep, digest]) if keep_repeats else roots
    return rows.select(f"{row}.*").union(docs.where(F.col(id_col).isNull()))


def dedup_lines(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """Docs with the lines removed from text_col that match an earlier line: by id, then by place
    in the text. Lines match when the Jaccard similarity of their sets of k-word shingles (a
    shorter line is one token) is percent/100 or more; lines without words stay. size_col, if docs
    has it, becomes the new text's length in characters.

    Every row is kept, even if no line is left (its text is then empty); rows with a null id, and
    null texts, stay as they are. Rows of one id count as one document: what is removed from one is
    removed from all, and of equal lines at the same place both stay. Lines are compared whole,
    whatever their length; an empty table gives an empty result; other columns stay as they are.
    """
    found = similar_sets(docs, Join(k, percent, lines), "earlier", id_col, text_col)
    firsts = found.classes.join(found.linked, "first", "left_anti").select(F.col("first.doc").alias("doc"), F.col("first.line").alias("line"))
    kept = firsts.union(found.units.where("n = 0").select("doc", "line")).distinct()
    key, keep, parts = (free_name(docs, x) for x in ("doc", "keep", "parts"))
    by_doc = kept.groupBy(F.col("doc").alias(key)).agg(F.array_sort(F.collect_list("line")).alias(keep))  # at most a document's lines
    rows = docs.join(by_doc, docs[id_col].cast("long") == F.col(key), "left")
    # an array of one struct names its fields within the lambda, where the text is cut only once
    both = F.array(F.struct(F.split(F.col(text_col), "\n").alias("cut"), F.col(keep).alias("keep")))
    left = F.get(F.transform(both, lambda b: F.array_join(F.transform(b["keep"], lambda at: F.get(b["cut"], at)), "\n")), F.lit(0))
    text = F.when(F.col(id_col).isNull() | F.col(text_col).isNull(), F.col(text_col)).when(F.col(keep).isNull(), F.lit("")).otherwise(left)
    out = rows.withColumn(parts, text).withColumn(text_col, F.col(parts))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(id_col).isNull() | F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col).cast(docs.schema[size_col].dataType)))
    return out.select(*docs.columns)
