"""Article sources: XML (also gzipped), JSON lines, HTML pages; the search collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T

ARTICLE = "pmid string, title string, abstract string, mesh array<string>, pubdate string, journal string, empty_abstract boolean"
ROW = "PubmedArticle"
#: An opening tag with any attributes, but no empty element.
OPEN = r"<{0}(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/))?>"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _inner(xml: Column, path: str) -> Column:
    """All text inside the first element of a path, inline markup flattened and entities resolved; '' if there is none."""
    return _plain(F.xpath_string(xml, F.lit(path)))


def shape_article(xml: Column) -> list[Column]:
    """The fields of ARTICLE from a record's XML."""
    top = f"{ROW}/MedlineCitation"
    journal, date = f"{top}/Article/Journal", f"{top}/Article/Journal/JournalIssue/PubDate"
    found = F.regexp_extract(xml, r"(?s)<Abstract(?:\s[^>]*)?>(.*?)</Abstract>", 1)
    parts = F.regexp_extract_all(found, F.lit("(?s)" + OPEN.format("AbstractText") + ".*?</AbstractText>"), F.lit(0))

    def section(part: Column) -> Column:
        label, body = F.xpath_string(part, F.lit("AbstractText/@Label")), _inner(part, "AbstractText")
        return F.when(F.coalesce(label, F.lit("")) != "", F.concat(label, F.lit(": "), body)).otherwise(body)

    abstract = _plain(F.array_join(F.filter(F.transform(parts, section), lambda x: x != ""), " "))
    mesh = F.filter(F.xpath(xml, F.lit(f"{top}/MeshHeadingList/MeshHeading/DescriptorName/@UI")), lambda u: u != "")
    pubdate = T.pubdate(_inner(xml, f"{date}/Year"), _inner(xml, f"{date}/Month"), _inner(xml, f"{date}/MedlineDate"))
    return [
        _inner(xml, f"{top}/PMID").alias("pmid"), _inner(xml, f"{top}/Article/ArticleTitle").alias("title"), abstract.alias("abstract"), mesh.alias("mesh"),
        pubdate.alias("pubdate"), _inner(xml, f"{journal}/Title").alias("journal"), (abstract == "").alias("empty_abstract"),
    ]


def read_articles_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Articles of XML files (.xml, .xml.gz; folders with all below them); rows without an id go.

    Files are read as text cut at each record's end tag, so that large plain files
    are split, and each record is parsed on its own: mixed content keeps all text.
    """
    raw = spark.read.option("lineSep", f"</{ROW}>").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,xml.gz}").text(path)
    body = F.regexp_extract("value", rf"(?s)<{ROW}(?:\s[^>]*)?>.*", 0)
    rows = raw.select(body.alias("body")).filter("body <> ''").select(F.concat("body", F.lit(f"</{ROW}>")).alias("xml"))
    return rows.select(*shape_article(F.col("xml"))).filter("pmid <> ''")


def read_articles_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(ARTICLE).json(path).filter("pmid is not null and pmid <> ''")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines; the number of rows written."""
    df.write.mode(mode).json(path)
    return df.sparkSession.read.text(path).count()


def to_collection(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("pmid").alias("id"), F.trim(F.concat_ws(" ", "title", "abstract")).alias("contents"))


def doc_texts(ids: DataFrame, collection: DataFrame) -> DataFrame:
    """(id, contents) of each distinct id; '' where there is no document."""
    return ids.distinct().join(collection, "id", "left").select("id", F.coalesce("contents", F.lit("")).alias("contents"))


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, n_paragraphs, chars): the title and the paragraphs of raw pages, tags stripped."""
    title = T.strip_markup(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))
    ps = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), T.strip_markup)
    return pages.select(key, title.alias("title"), F.size(ps).alias("n_paragraphs"), F.aggregate(ps, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))
