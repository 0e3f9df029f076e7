"""Text functions as Column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s+"
TERM = "[a-z0-9]+"
#: Fixed: the default cue patterns of the contradiction filter.
CUES = [
    r"\bno evidence of\b",
    r"\babsence of\b",
    r"\bdid not\b",
    r"\bfailed to\b",
    r"\bno association\b",
    r"\bno significant difference\b",
    r"\bcontrary to\b",
    r"\bin contrast to\b",
    r"\bhowever\b",
    r"\bdid not find\b",
    r"\bwas not associated\b",
    r"\bno effect\b",
    r"\bno significant effect\b",
    r"\bno difference\b",
    r"\bruled out\b",
    r"\brefuted\b",
    r"\binconsistent with\b",
    r"\bwas not significant\b",
    r"\bdid not support\b",
    r"\bno benefit\b",
    r"\bdid not improve\b",
    r"\bdid not reduce\b",
    r"\bno correlation\b",
]
#: Fixed: prices in dollars per million tokens, (input, output); other backends cost nothing.
PRICES = {
    "together-llama-3.3-70b": (0.88, 0.88),
    "openai-gpt-4o-mini": (0.15, 0.60),
    "openai-gpt-4o": (2.50, 10.00),
    "hf-llama-3.3-70b": (0.59, 0.79),
    "hf-qwen-2.5-72b": (0.90, 0.90),
}
LABELS = {"supports": "Supports", "contradicts": "Contradicts", "neutral": "Neutral", "not relevant": "Not relevant"}


def sentence_split(text: Column) -> Column:
    """Array of trimmed, non-empty sentences; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), F.trim)
    return F.filter(parts, lambda x: x != "")


def cue_match(text: Column, patterns: list[str] | None = None) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(CUES if patterns is None else patterns)), F.lit(False))


def query_build(question: Column, sentence: Column) -> Column:
    return F.trim(F.concat_ws(" ", question, sentence))


def truncate_tokens(text: Column, n: int) -> Column:
    """The first n white-space tokens joined by a space; texts of up to n tokens only stripped."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    words = F.split(t, SPACE)
    return F.when(F.size(words) <= n, t).otherwise(F.array_join(F.slice(words, 1, n), " "))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def expand_query(query: Column, more: Column) -> Column:
    return F.when(F.size(more) > 0, F.concat_ws(" ", query, F.array_join(more, " "))).otherwise(query)


def label_normalise(raw: Column) -> Column:
    """A judge's answer as one of the four labels; unknown answers are Neutral."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit("")), F.lit(" .\"'\n\t")))
    out = F.lit("Neutral")
    for word, label in (("supports", "Supports"), ("contradicts", "Contradicts"), ("neutral", "Neutral"), ("not", "Not relevant")):
        out = F.when(F.startswith(s, F.lit(word)), label).otherwise(out)
    for k, v in LABELS.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def json_span(reply: Column) -> Column:
    """From the first { to the last }; the reply itself if it has none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(reply)


def parse_judgement(reply: Column) -> Column:
    """struct(label, confidence) of a reply; (Neutral, 0) if it holds no JSON object.

    An object without a label, or with an unknown one, is Neutral and keeps its
    confidence; a confidence that isn't a number is 0, others are clipped to [0, 1].
    """
    doc = json_span(F.coalesce(reply, F.lit("")))
    readable = F.try_parse_json(doc).isNotNull() & F.startswith(F.ltrim(doc), F.lit("{"))
    conf = F.coalesce(F.get_json_object(doc, "$.confidence").try_cast("double"), F.lit(0.0))
    conf = F.when(F.isnan(conf), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))
    label = label_normalise(F.get_json_object(doc, "$.label"))
    return F.struct(F.when(readable, label).otherwise("Neutral").alias("label"), F.when(readable, conf).otherwise(F.lit(0.0)).alias("confidence"))


def parse_rewrites(reply: Column, n: int) -> Column:
    """The first n non-empty trimmed strings of queries[]."""
    arr = F.from_json(F.get_json_object(json_span(F.coalesce(reply, F.lit(""))), "$.queries"), "array<string>")
    typed = F.from_json(F.get_json_object(json_span(F.coalesce(reply, F.lit(""))), "$.queries"), "array<variant>")
    strings = F.filter(F.transform(F.arrays_zip(arr.alias("s"), typed.alias("v")), lambda x: F.when(F.schema_of_variant(x["v"]) == "STRING", F.trim(x["s"]))), lambda s: s.isNotNull() & (s != ""))
    return F.slice(F.coalesce(strings, F.array().cast("array<string>")), 1, n)


def chat_messages(system: str, user: Column) -> Column:
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


#: What the models are asked, in our own words; other wordings may be passed.
JUDGE_ASKED = "Judge how an abstract bears on an answer sentence. Choose Supports, Contradicts, Neutral or Not relevant, and say how sure you are. Reply with JSON only: an object with the fields label and confidence (0 to 1)."
FILTER_ASKED = "Decide whether an abstract is about the same topic as an answer sentence, so that it could help to check it; it need not state the claim. Reply with JSON only: an object with the boolean field relevant."
REWRITE_ASKED = "Write short keyword queries for a literature search that would find evidence for or against a sentence, each in other terms. Reply with JSON only: an object with the field queries, a list of strings."


def _stripped(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r"))


def _sentence_and_abstract(sentence: Column, abstract: Column, tokens: int) -> Column:
    return F.concat(F.lit("Answer sentence:\n"), _stripped(sentence), F.lit("\n\nAbstract:\n"), truncate_tokens(abstract, tokens))


def judge_messages(sentence: Column, abstract: Column, system: str = JUDGE_ASKED, tokens: int = 3000) -> Column:
    """The messages of a judge's call, as JSON."""
    return chat_messages(system, _sentence_and_abstract(sentence, abstract, tokens))


def filter_messages(sentence: Column, abstract: Column, system: str = FILTER_ASKED, tokens: int = 250) -> Column:
    return chat_messages(system, _sentence_and_abstract(sentence, abstract, tokens))


def rewrite_messages(question: Column, sentence: Column, n: int = 3, system: str = REWRITE_ASKED) -> Column:
    user = F.concat(F.lit("Question: "), _stripped(question), F.lit("\nAnswer sentence: "), _stripped(sentence), F.lit(f"\n\nWrite {n} varied search queries that target the claim."))
    return chat_messages(system, user)


def parse_relevant(reply: Column) -> Column:
    """Whether a reply says {"relevant": true}; replies that can't be read say no."""
    return F.coalesce(F.lower(F.get_json_object(json_span(F.coalesce(reply, F.lit(""))), "$.relevant")) == "true", F.lit(False))


def premise(abstract: Column, sentence: Column) -> Column:
    """Fixed: the input of a text-to-text model for natural language inference."""
    return F.concat(F.lit("mednli: premise: "), F.coalesce(abstract, F.lit("")), F.lit(" hypothesis: "), F.coalesce(sentence, F.lit("")))


def judge_cost(backend: Column, tokens_in: Column, tokens_out: Column, prices: dict | None = None) -> Column:
    out = F.lit(0.0)
    for name, (a, b) in (PRICES if prices is None else prices).items():
        out = F.when(backend == name, F.round((tokens_in * F.lit(float(a)) + tokens_out * F.lit(float(b))) / 1e6, 6)).otherwise(out)
    return out


def label_to_class(label: Column) -> Column:
    return F.when(label == "Supports", "support").when(label == "Contradicts", "contradict")


def class_to_label(cls: Column) -> Column:
    return F.when(cls.isin("support", "partial_support"), "Supports").when(cls.isin("contradict", "partial_contradict"), "Contradicts")


def base_class(cls: Column) -> Column:
    return F.regexp_replace(cls, "^partial_", "")


def fold_of(topic: Column, k: int) -> Column:
    """First 8 bytes of sha1, big-endian, modulo k."""
    return (F.conv(F.substring(F.sha1(topic.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(k)).cast("int")


def prompt_key(sentence: Column, abstract: Column) -> Column:
    return F.sha1(F.concat(sentence.cast("binary"), F.lit(b"\x00"), abstract.cast("binary")))


def excerpt(*candidates: Column, width: int = 140) -> Column:
    """The first candidate there is, newlines as spaces, clipped with an ellipsis."""
    s = F.trim(F.replace(F.coalesce(*candidates, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s)


def l2_normalise(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(F.lit(1e-12), norm))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from a key: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def strip_markup(html: Column) -> Column:
    """Text of a markup fragment: tags go, the five named entities are resolved."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(t)


def pubdate(year: Column, month: Column, medline: Column) -> Column:
    """YYYY-MM, or YYYY, or the first 7 characters of a free-form date."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    short = F.lower(F.substring(F.trim(month), 1, 3))
    number = F.lpad(F.substring(F.trim(month), 1, 2), 2, "0")
    for i, m in enumerate(names, 1):
        number = F.when(short == m, f"{i:02d}").otherwise(number)
    y = F.trim(F.coalesce(year, F.lit("")))
    has_month = F.trim(F.coalesce(month, F.lit(""))) != ""
    return F.when(y == "", F.substring(F.trim(F.coalesce(medline, F.lit(""))), 1, 7)).when(has_month, F.concat(y, F.lit("-"), number)).otherwise(y)


def numeric_order(topic: Column) -> list[Column]:
    """Sort keys: numeric ids by value, others last, then by text."""
    return [F.coalesce(topic.try_cast("long"), F.lit(2147483648)), topic]
