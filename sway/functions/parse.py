"""Column expressions that turn raw prediction/prompt lines into trials.

All are native Spark expressions (JSON, regex, hash), so they run inside
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer patterns, tried in this order, first match wins
# (a ``|`` inside the class is a literal pipe, kept as in the study).
ANSWER_PATTERNS = (
    r"(?i)position ([A|B])",
    r"(?i)position <<([A|B])>>",
    r"(?i)<<([A|B])>>",
    r"(?i)^\s*([A|B])\s*$",
)

# Fixed value: the shape of a packed request id.
ID_HEAD = r"request-(.*?)-(\d+)-framing"

# Reply schema: the union of the four reply dialects.  A reply that is a
# plain string leaves ``response`` NULL here and is read as text instead.
PREDICTION_SCHEMA = (
    "custom_id string, llm_answer string, prompt_text string, "
    "request struct<custom_id string, labels struct<custom_id string>, "
    "  contents array<struct<parts array<struct<text string>>>>, "
    "  messages array<struct<content string>>>, "
    "response struct<content array<struct<text string>>, "
    "  candidates array<struct<content struct<parts array<struct<text string>>>>>, "
    "  choices array<struct<message struct<content string>>>, "
    "  body struct<choices array<struct<message struct<content string>>>>>"
)


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_prediction(value: Column) -> Column:
    """JSON line -> struct with the superset schema (PERMISSIVE, partial results)."""
    return F.from_json(value, PREDICTION_SCHEMA)


def custom_id_of(j: Column) -> Column:
    """First non-empty of top-level, ``request.labels`` and ``request`` custom_id."""
    return F.coalesce(_nz(j["custom_id"]), _nz(j["request"]["labels"]["custom_id"]),
                      _nz(j["request"]["custom_id"]))


def response_text(value: Column, j: Column) -> Column:
    """Reply text from a plain string or one of the nested reply dialects, else ''."""
    r = j["response"]
    nested = F.coalesce(
        F.get(r["content"], 0)["text"],
        F.get(F.get(r["candidates"], 0)["content"]["parts"], 0)["text"],
        F.get(r["choices"], 0)["message"]["content"],
        F.get(r["body"]["choices"], 0)["message"]["content"],
        F.lit(""))
    return F.when(r.isNotNull(), nested).otherwise(
        F.coalesce(F.get_json_object(value, "$.response"), F.lit("")))


def request_text(j: Column, contents_first: bool = True) -> Column:
    """Prompt text from the request payload; path precedence follows the caller."""
    req = j["request"]
    contents = F.get(F.get(req["contents"], 0)["parts"], 0)["text"]
    content = F.get(req["messages"], 0)["content"]
    # A list of content parts arrives as its JSON text: its first part's text counts.
    messages = F.when(content.startswith("["), F.coalesce(F.get_json_object(content, "$[0].text"), content)).otherwise(content)
    first, second = (contents, messages) if contents_first else (messages, contents)
    return F.coalesce(_nz(first), _nz(second), j["prompt_text"], F.lit(""))


def answer_letter(text: Column, preserve_case: bool = False) -> Column:
    """First matching answer pattern's letter, else 'Other' (upper-cased unless asked)."""
    hits = [_nz(F.regexp_extract(text, p, 1)) for p in ANSWER_PATTERNS]
    letter = F.coalesce(*hits)
    if not preserve_case:
        letter = F.upper(letter)
    return F.coalesce(letter, F.lit("Other"))


def final_answer(text: Column, precomputed: Column | None = None) -> Column:
    """Honour a pre-extracted answer when it is one of A, B, Other."""
    a = answer_letter(text)
    if precomputed is None:
        return a
    return F.when(precomputed.isin("A", "B", "Other"), precomputed).otherwise(a)


def issue_stance(question_stance: Column, answer: Column) -> Column:
    """A keeps the question's orientation, B inverts it, anything else is 'other'."""
    qs = question_stance
    return (F.when((qs == "pro") & (answer == "A"), "pro")
            .when((qs == "con") & (answer == "A"), "con")
            .when((qs == "pro") & (answer == "B"), "con")
            .when((qs == "con") & (answer == "B"), "pro")
            .otherwise("other"))


def id_question(cid: Column) -> Column:
    return F.lower(F.replace(F.regexp_extract(cid, ID_HEAD, 1),
                             F.lit("_"), F.lit(" ")))


def id_trial(cid: Column) -> Column:
    return F.regexp_extract(cid, ID_HEAD, 2).try_cast("int")


def id_framing(cid: Column) -> Column:
    return F.regexp_extract(cid, r"-framing-(.*?)-evidence-", 1)


def id_case(cid: Column) -> Column:
    return F.try_element_at(F.split(cid, "-evidence-"), F.lit(2))


def id_is_valid(cid: Column) -> Column:
    return cid.rlike(ID_HEAD) & F.instr(cid, "-evidence-").__gt__(0)


def request_text_hash(text: Column) -> Column:
    """SHA-1 of whitespace-collapsed, trimmed, lower-cased text; NULL when empty."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))
    return F.when(F.length(norm) > 0, F.sha1(norm))


def model_from_file(path: Column, kind: str = "predictions") -> Column:
    """``.../<kind>_<model>[_<n>].jsonl[/...]`` -> model (file name or a folder of part files)."""
    return F.regexp_extract(path, kind + r"_([^/]*?)(?:_\d+)?\.jsonl(?:/|$)", 1)


# The union of the request lines that prompt files hold.
PROMPT_SCHEMA = (
    "custom_id string, prompt string, "
    "request struct<custom_id string, labels struct<custom_id string>, "
    "  contents array<struct<parts array<struct<text string>>>>, messages array<struct<content string>>>, "
    "body struct<messages array<struct<content string>>>"
)


def parse_prompt(value: Column) -> Column:
    """Request line of a prompt file -> struct (custom_id, text): the request's text in any of the providers' formats."""
    j = F.from_json(value, PROMPT_SCHEMA)
    body = F.get(j["body"]["messages"], 0)["content"]
    asked = F.get(F.get(j["request"]["contents"], 0)["parts"], 0)["text"]
    text = F.coalesce(_nz(asked), _nz(F.get(j["request"]["messages"], 0)["content"]), _nz(body), _nz(j["prompt"]), F.lit(""))
    return F.struct(custom_id_of(j).alias("custom_id"), text.alias("text"))


def clean_text(c: Column) -> Column:
    """NULL, NaN or the string 'nan' -> ''."""
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "nan"), F.lit("")).otherwise(c)


def slugify(url: Column) -> Column:
    """Last path segment of a URL (trailing slashes dropped) without ``-debate``."""
    return F.replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1),
                     F.lit("-debate"), F.lit(""))


def with_answer(df, text_col: str = "response_text", out: str = "llm_answer"):
    """Add the parsed answer, evaluated once per row inside a generator (a later filter on
    it is not pushed below, which would re-run the regexes on the inlined text expression)."""
    return df.select("*", F.inline(F.array(F.struct(answer_letter(F.col(text_col)).alias(out)))))


def issue_slug(text: Column) -> Column:
    """Lower-case, '&' -> 'and', spaces -> '-', '--' -> '-'."""
    s = F.replace(F.lower(text), F.lit("&"), F.lit("and"))
    return F.replace(F.replace(s, F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))


def title_case(text: Column) -> Column:
    """Python ``str.title``: a cased letter is upper-cased when the character before it is
    not a cased letter, lower-cased otherwise (a letter whose upper case is two keeps the second low)."""
    title = lambda c: F.concat(F.substring(F.upper(c), 1, 1), F.lower(F.substring(F.upper(c), 2, 2)))
    chars = F.split(text, "")
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        (i == 0) | ~F.get(chars, i - 1).rlike(cased), title(c)).otherwise(F.lower(c))), "")


def issue_title(slug: Column) -> Column:
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


# List-title prefix of an argument heading ("Pro 1: ", "### Con 2: ").
TITLE_PREFIX = r"(?i)(?:\s*#+)?\s*(Pro|Con)\s+\d+:\s+"


def strip_title_prefix(text: Column) -> Column:
    return F.regexp_replace(text, TITLE_PREFIX, "")
