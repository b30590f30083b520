"""Text expressions: tokens, routing, citations and cleaning, all as native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
STOPWORDS = (
    "the a an and or of to in on for with is are was were be by at as it "
    "der die das den dem des ein eine einer eines und oder von zu im auf für mit ist sind"
).split()
SUMMARY_WORDS = "summarize summarise summary overview recap tldr tl dr zusammenfassung zusammenfassungen zusammenfassen kurzfassung überblick übersicht fasse fass fasst fassen zusammen".split()
CORPUS_WORDS = (
    "how many number which what list documents document docs doc files file sources source pdfs pdf notes note "
    "do i have got my me all there cover covers covering about regarding concerning topic "
    "wie viele anzahl welche welchem welcher welches welchen liste zeig zeige zeigt dokumente dokumenten dokument dateien datei quellen quelle unterlagen notizen "
    "alle aller allen habe hab ich mir mich mein meine meiner meinen gibt es zum zur thema über ueber behandeln behandelt decken deckt ab gehen geht handeln handelt steht stehen enthalten enthält"
).split()
SUMMARY_RULE = (
    r"(?iu)(?<![A-Za-z0-9_])(?:summari[sz]e|summary|tl;?dr|overview|recap|in (?:a |one )?(?:few|short) (?:words|sentences))(?![A-Za-z0-9_])"
    r"|zusammenfass|kurzfassung|überblick|übersicht|(?<![A-Za-z0-9_])fass(?:e|t|en)?(?![A-Za-z0-9_])[^.?!\n]{0,40}(?<![A-Za-z0-9_])zusammen(?![A-Za-z0-9_])"
)
BROAD_RULE = (
    r"(?iu)(?<![A-Za-z0-9_])(?:list (?:all|every|each|the)|enumerate|what are (?:all|the)|which (?:ones|of|are)|every|each of|compare|contrast|differences? between|similarit(?:y|ies)|versus|vs|alle|jede[rs]?|welche|nenne|zähl(?:e|en)?(?![A-Za-z0-9_])[^.?!\n]{0,40}(?<![A-Za-z0-9_])auf)(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])vergleich|(?<![A-Za-z0-9_])unterschied|sämtliche|gegenüber"
)
_NOUN = "(?:documents?|docs?|files?|sources?|pdfs?|notes?|dokumente?n?|dateien?|quellen?|unterlagen|notizen)"
_EN = r"(?:(?:of|my|the|all|these|those|such)\s+){0,3}"
_DE = r"(?:(?:der|die|den|des|von|an|meiner|meine|meinen|aller|dieser|diesen)\s+){0,3}"
_TAIL = r"(?![A-Za-z0-9_])(?!['’]|\s+(?:does|did|cited)(?![A-Za-z0-9_]))"
_B = r"(?<![A-Za-z0-9_])"
COUNT_RULE = rf"(?i){_B}(?:(?:how many|number of)\s+{_EN}|(?:wie ?viele|anzahl)\s+{_DE}){_NOUN}{_TAIL}"
LIST_RULE = (
    rf"(?i){_B}(?:(?:which|list)\s+{_EN}|(?:welche[mrns]?|liste)\s+{_DE}|zeig(?:e|t)?\s+(?:mir\s+)?{_DE}(?:alle\s+)?){_NOUN}{_TAIL}"
    rf"|{_B}what\s+{_EN}{_NOUN}(?![A-Za-z0-9_])[^.?!\n]{{0,30}}{_B}do i have(?![A-Za-z0-9_])"
)
GERMAN_WORDS = "was wie wer wo wann warum welche der die das ist sind und nicht ein eine".split()
CODE_EXTENSIONS = "json yaml yml toml ts tsx js jsx mjs cjs py go rs java kt c h cpp hpp cs rb php swift sh html css scss sql xml".split()
MIME_BY_EXTENSION = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "rst": "text/x-rst"}
LAZY_OPTIONS = ("all of the above", "none of the above", "all the above", "alle der oben genannten", "keine der oben genannten", "alle oben genannten", "alle genannten", "keine der genannten")
CITATION = r"\[doc:(\d+),\s*chunk:(\d+)\]"
REWRITE_LABEL = r"(?i)^(?:query|search|standalone query|rewritten|user question|follow[- ]?up|here is[^\n]*?):\s*"
EDGE_QUOTES = r"(?U)^[`'\"\s]+|[`'\"\s]+$"
END_SECTIONS = ("Einzelnachweise", "Weblinks", "Literatur", "Siehe auch", "Anmerkungen", "Quellen", "References", "External links", "See also", "Further reading", "Notes")
CHARS_PER_TOKEN = 3.5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c) -> Column:
    """Strips every kind of white space, as opposed to spaces only."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapse(c) -> Column:
    return trim_all(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def words_without(c, excluded) -> Column:
    parts = F.split(F.lower(_col(c)), "[^a-zA-Z0-9äöüß]+")
    return F.filter(parts, lambda t: (F.length(t) > 0) & ~t.isin(*excluded))


def content_tokens(c) -> Column:
    """Lower-case tokens without stopwords, in order, repeats kept."""
    return words_without(c, STOPWORDS)


def theme_tokens(c) -> Column:
    return words_without(c, STOPWORDS + CORPUS_WORDS)


def split_questions(c) -> Column:
    """Sub-questions: two to five parts that end in '?', else the whole text."""
    whole = trim_all(c)
    parts = F.filter(F.transform(F.split(whole, r"(?<=\?)"), trim_all), lambda s: (F.length(s) >= 10) & (F.size(content_tokens(s)) >= 1))
    return F.when(F.size(parts).between(2, 5), parts).otherwise(F.array(whole))


def query_breadth(c) -> Column:
    return F.when(_col(c).rlike(SUMMARY_RULE), "summary").when(_col(c).rlike(BROAD_RULE), "broad").otherwise("focused")


def adaptive_k(c) -> Column:
    b = query_breadth(c)
    return F.when(b == "summary", 12).when(b == "broad", 8).otherwise(3)


def corpus_intent(c) -> Column:
    return F.when(_col(c).rlike(COUNT_RULE), "count").when(_col(c).rlike(LIST_RULE), "list")


def guess_de_en(c) -> Column:
    word = rf"(?i){_B}(?:{'|'.join(GERMAN_WORDS)})(?![A-Za-z0-9_])"
    return F.when(_col(c).rlike("(?iu)[äöüß]") | _col(c).rlike(word), "de").otherwise("en")


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(_col(c)) / CHARS_PER_TOKEN).cast("long")


def model_stem(c) -> Column:
    """Model name without provider, path, tag and file suffix."""
    last = F.regexp_replace(F.regexp_replace(_col(c), r"^[^:/]+://", ""), r"^.*/", "")
    return F.regexp_replace(F.lower(F.regexp_replace(last, r":.*$", "")), r"-gguf$", "")


def _extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./\\]*)$", 1))


def classify_doc_type(path, mime=None) -> Column:
    e = _extension(path)
    known = F.when(e == "pdf", "pdf").when(e == "docx", "docx").when(e.isin("md", "markdown"), "md").when(e.isin(*CODE_EXTENSIONS), "code").when(e.isin("txt", "rst"), "txt")
    if mime is None:
        return F.coalesce(known, F.lit("txt"))
    by_mime = F.when(_col(mime) == MIME_BY_EXTENSION["pdf"], "pdf").when(_col(mime) == MIME_BY_EXTENSION["docx"], "docx")
    return F.coalesce(known, by_mime, F.lit("txt"))


def mime_from_ext(path) -> Column:
    e = _extension(path)
    out = F.lit(None).cast("string")
    for k, v in MIME_BY_EXTENSION.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def contains_literal(text, part) -> Column:
    """Case-insensitive containment; no character of ``part`` is a wildcard."""
    return F.contains(F.lower(_col(text)), F.lower(_col(part)))


def normalise_key(c) -> Column:
    """Letters and digits in lower case, everything else one blank; of compatible() text where forms may differ."""
    return trim_all(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def compatible(c) -> Column:
    """Unicode's compatible composed form (NFKC), of a string or an array of strings.

    Only values with characters beyond ASCII go through Python; the others are their own form.
    """
    c = _col(c)

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.coalesce(form(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def compatible_all(c) -> Column:
    """compatible() for each string of an array."""
    c = _col(c)

    @F.pandas_udf("array<string>")
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda vs: None if vs is None else [None if v is None else unicodedata.normalize("NFKC", v) for v in vs])

    return F.coalesce(form(F.when(F.array_join(c, "").rlike(r"[^\x00-\x7F]"), c)), c)


def strip_think(c) -> Column:
    return trim_all(F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", ""))


def condense(c, most: int) -> Column:
    t = collapse(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def clean_rewrite(c) -> Column:
    """First line with text, without quotes and a leading label."""
    first = F.get(F.filter(F.transform(F.split(_col(c), r"\r?\n"), trim_all), lambda s: F.length(s) > 0), F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(first, EDGE_QUOTES, ""), REWRITE_LABEL, "")
    return F.coalesce(F.regexp_replace(bare, EDGE_QUOTES, ""), F.lit(""))


def clean_hypothesis(c) -> Column:
    return trim_all(F.regexp_replace(strip_think(c), r"(?i)^\s*(?:translation|übersetzung)\s*:\s*", ""))


def strip_citations(c) -> Column:
    return F.regexp_replace(_col(c), CITATION, "")


def clean_page_text(c) -> Column:
    out = _col(c)
    for pattern, by in ((r"(?:[ \t]*\.){4,}[ \t]*", " "), (r"_{4,}", " "), (r"-{4,}", " "), (r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n")):
        out = F.regexp_replace(out, pattern, by)
    return out


def clean_extract(c, sections=END_SECTIONS) -> Column:
    """Text before the first line that is an end-section header, with tidy line ends."""
    head = F.element_at(F.split(_col(c), rf"(?m)^(?:{'|'.join(sections)})\s*$", 2), 1)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, "\r\n", "\n"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return trim_all(out)


def clean_markdown_images(c) -> Column:
    """Drops image references and shortens runs of blank lines, in one reading of the text."""
    marked = F.regexp_replace(_col(c), r"!\[[^\]]*\]\([^)]*\)", "\u0000")
    return F.regexp_replace(F.regexp_replace(marked, r"\n{3,}", "\n\n"), "\u0000", "")


def parse_score(c, name: str) -> Column:
    """``name: number`` clamped to 0..10 and scaled to 0..1; null if missing."""
    x = F.regexp_extract(_col(c), rf"(?i){name}\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1)
    return F.when(x != "", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.expr("0.0D") + x.try_cast("double"))) / 10)


def hit_header(doc, chunk, title, heading=None, page=None, language=None, answer_language: str | None = None) -> Column:
    parts = []
    if heading is not None:
        parts.append(F.when(F.size(_col(heading)) > 0, F.concat(F.lit(", § "), F.array_join(_col(heading), " › "))).otherwise(""))
    if page is not None:
        parts.append(F.when(_col(page).isNotNull(), F.concat(F.lit(", p."), _col(page).cast("string"))).otherwise(""))
    if language is not None and answer_language:
        lang = _col(language)
        parts.append(F.when(lang.isNotNull() & ~lang.isin("other", answer_language), F.concat(F.lit(", lang:"), lang)).otherwise(""))
    number = lambda x: _col(x).cast("string")
    return F.concat(F.lit("[doc:"), number(doc), F.lit(", chunk:"), number(chunk), F.lit("] ("), _col(title), *parts, F.lit(")"))
