"""JSON of model answers and of posts handed in by callers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.constants import MISSING_EN, MISSING_KO
from feedloom.functions.text import let, no_strings, trim_u


def kind(v: Column) -> Column:
    """Type name of a variant: STRING, VOID, BIGINT, `ARRAY<...>`, `OBJECT<...>`."""
    return F.schema_of_variant(v)


def _is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def _is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def _elements(v: Column) -> Column:
    return F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def _text(v: Column) -> Column:
    return F.when(_is_text(v), F.try_variant_get(v, "$", "string"))


def _text_or_null_only(elements: Column) -> Column:
    return F.forall(elements, lambda e: _is_text(e) | (kind(e) == "VOID"))


def _texts(elements: Column) -> Column:
    return F.transform(elements, _text)


def string_array_lenient(v: Column) -> Column:
    """Texts of an array, of JSON text of an array, or the text itself as the only one."""

    def texts(e: Column) -> Column:
        return _texts(F.filter(_elements(e), _is_text))

    inner = F.try_parse_json(_text(v))
    return F.when(_is_array(v), texts(v)).when(
        _is_text(v), F.when(_is_array(inner), texts(inner)).otherwise(F.array(_text(v)))
    )


def field_any_case(v: Column, name: str) -> Column:
    """A member by its camelCase or PascalCase name, as a variant."""
    pascal = name[0].upper() + name[1:]
    return F.coalesce(
        F.try_variant_get(v, f"$.{name}", "variant"), F.try_variant_get(v, f"$.{pascal}", "variant")
    )


def field_text(v: Column, name: str) -> Column:
    return _text(field_any_case(v, name))


def model_content(body: Column) -> Column:
    return F.get_json_object(body, "$.choices[0].message.content")


def strip_code_fence(content: Column) -> Column:
    bare = F.regexp_replace(trim_u(content), r"^(```json)?(```)?", "")
    return trim_u(F.regexp_replace(bare, r"```\z", ""))


def insight_items(content: Column) -> Column:
    """Usable items of a model answer: pos, index and bullets.

    An item with an index that is no integer, or a bullet that is no text, is left out.
    """
    items = _elements(F.try_variant_get(F.try_parse_json(content), "$.items", "variant"))

    def item(v: Column, pos: Column) -> Column:
        index = F.try_variant_get(v, "$.index", "variant")
        bullets = _elements(F.try_variant_get(v, "$.koreanSummary", "variant"))
        usable = F.coalesce(kind(index) == "BIGINT", F.lit(False)) & F.coalesce(
            _text_or_null_only(bullets), F.lit(False)
        )
        texts = F.filter(_texts(bullets), lambda t: F.coalesce(t != "", F.lit(False)))
        return F.struct(
            pos.alias("pos"),
            F.when(usable, F.try_variant_get(index, "$", "int")).alias("index"),
            F.when(usable, texts).otherwise(no_strings()).alias("bullets"),
        )

    return F.filter(
        F.transform(items, item), lambda s: s["index"].isNotNull() & (F.size(s["bullets"]) > 0)
    )


def items_given(content: Column) -> Column:
    """Whether the answer is an object with an `items` array; null when it is no JSON."""
    v = F.try_parse_json(content)
    return F.when(v.isNotNull(), _is_array(F.try_variant_get(v, "$.items", "variant")))


# --- summaries of a single post ----------------------------------------------------------


def _member_nocase(v: Column, name: str) -> Column:
    members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    same = F.filter(members, lambda m: F.lower(m["key"]) == name.lower())
    return F.get(same, F.size(same) - 1)["value"]


def _typed_ok(v: Column) -> Column:
    return v.isNull() | (kind(v) == "VOID") | F.coalesce(_text_or_null_only(_elements(v)), F.lit(False))


def _typed(v: Column, missing: str) -> Column:
    return (
        F.when(v.isNull(), no_strings())
        .when(kind(v) == "VOID", F.array(F.lit(missing)))
        .otherwise(_texts(_elements(v)))
    )


def _lines(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), trim_u), lambda x: x != "")
    return F.when(F.size(lines) > 1, lines).otherwise(F.array(text))


def _lenient(v: Column) -> Column:
    """Lines of an array, of JSON text or of plain text; null when an element is no text."""

    def filled(e: Column) -> Column:
        texts = F.transform(_texts(_elements(e)), lambda t: F.coalesce(t, F.lit("")))
        return F.when(_text_or_null_only(_elements(e)), texts)

    inner = F.try_parse_json(_text(v))
    return (
        F.when(_is_array(v), filled(v))
        .when(_is_text(v), F.coalesce(F.when(_is_array(inner), filled(inner)), _lines(_text(v))))
        .otherwise(no_strings())
    )


def _pair(en: Column, ko: Column) -> Column:
    return F.struct(en.alias("english_summary"), ko.alias("korean_summary"))


def parse_summary_lenient(content: Column) -> Column:
    """English and Korean lines of a model answer in any of the shapes models return."""
    missing = _pair(F.array(F.lit(MISSING_EN)), F.array(F.lit(MISSING_KO)))

    def typed(v: Column) -> Column:
        en, ko = _member_nocase(v, "englishSummary"), _member_nocase(v, "koreanSummary")
        return F.when(
            _is_object(v) & _typed_ok(en) & _typed_ok(ko),
            _pair(_typed(en, MISSING_EN), _typed(ko, MISSING_KO)),
        )

    def loose(root: Column) -> Column:
        en, ko = (_lenient(field_any_case(root, n)) for n in ("englishSummary", "koreanSummary"))
        pair = let(
            _pair(en, ko),
            lambda p: F.when(
                F.size(p.english_summary) + F.size(p.korean_summary) > 0, p
            ),
        )
        return F.when(_is_object(root), pair)

    def read(v: Column) -> Column:
        root = F.when(_is_text(v), F.try_parse_json(_text(v))).otherwise(v)
        return F.coalesce(typed(v), let(root, loose), missing)

    return let(F.try_parse_json(content), read)


# --- first array of texts ----------------------------------------------------------------

_STRING = r'"(?:[^"\\]|\\.)*+"'
_STRING_ARRAY = rf"\[\s*+{_STRING}(?:\s*+,\s*+{_STRING})*+\s*+\]"
_BEFORE = rf'(?:[^"\[]++|{_STRING}|(?!{_STRING_ARRAY})\[)*+'


def _bracketed(text: Column) -> Column:
    """The first bracketed piece, if it is a JSON array of texts."""

    def texts(v: Column) -> Column:
        ok = _text_or_null_only(_elements(v)) & (F.size(_elements(v)) > 0)
        return F.when(ok, _texts(_elements(v)))

    return let(F.try_parse_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0)), texts)


def first_string_array(content: Column) -> Column:
    """The first array of texts: the first bracketed piece, else the first one in JSON order,
    else a bracketed piece of the message content; null when there is none."""
    anywhere = F.regexp_extract(content, rf"(?s)^{_BEFORE}({_STRING_ARRAY})", 1)
    valid = F.try_parse_json(content).isNotNull() & (anywhere != "")
    return F.coalesce(
        _bracketed(content),
        F.when(valid, F.from_json(anywhere, "array<string>")),
        _bracketed(model_content(content)),
    )


def bullet_text(lines: Column) -> Column:
    """Bullets as JSON text; Korean stays readable."""
    return F.to_json(lines)


