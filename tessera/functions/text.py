"""Token estimates, hashes, flattening of host content, and the index tokeniser: column expressions only."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONVERSATION, DEFAULTS, Settings
from ..schemas import BLOCKS

_BLANK = r"(?U)^\s+|\s+$"


#: Letters that fold on their own, whatever stands beside them.
SPECIAL, FOLDED = "\u03a3\u03c2\u0130\u017f\u1e9b", "\u03c3\u03c3iss"


def _folds() -> tuple[str, str]:
    """Latin letters with one mark (U+00C0 to U+024F and U+1E00 to U+1EFF) and the ASCII letter that each decomposes to."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) == 2 and parts[0].isascii() and chr(code) == chr(code).lower():
            pairs.append((chr(code), parts[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _folds()


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def estimate_tokens_utf16(text: Column) -> Column:
    """A quarter of the UTF-16 code units, rounded up."""
    return F.coalesce(F.floor((F.octet_length(F.encode(text, "UTF-16BE")) / 2 + 3) / 4), F.lit(0)).cast("long")


def blank_trim(text: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.regexp_replace(text, _BLANK, "")


def or_else(text: Column, *fallbacks: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *fallbacks[:-1])], fallbacks[-1])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def pointer_for(content: Column) -> Column:
    return F.concat(F.lit("e:"), content_hash(content))


def pointer_line(pointer: Column, settings: Settings = DEFAULTS) -> Column:
    return F.format_string(settings.pointer_format, pointer)


def label_passage(collection: Column, text: Column, session_id: Column, cwd: Column) -> Column:
    label = F.concat(F.lit("[session:"), F.coalesce(session_id, F.lit("")), F.lit(" cwd:"), F.coalesce(cwd, F.lit("")), F.lit("]\n"), text)
    return F.when(collection == CONVERSATION, label).otherwise(text)


def _block_text(block: Column, inner) -> Column:
    """Text of one block (a VARIANT): its text, else its content, which is text or flattened by ``inner``."""
    field = lambda name: F.variant_get(block, f"$.{name}", "variant")
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    is_block = F.schema_of_variant(block).startswith("OBJECT")
    return F.coalesce(F.when(is_block, F.coalesce(string(field("text")), string(field("content")), inner(field("content")))), F.lit(""))


def _flat(content: Column, depth: int) -> Column:
    """Text of an array of blocks (a VARIANT) nested up to ``depth``; null for anything else."""
    blocks = F.variant_get(F.when(F.schema_of_variant(content).startswith("ARRAY"), content), "$", "array<variant>")
    inner = (lambda v: _flat(v, depth - 1)) if depth else (lambda v: F.lit(None).cast("string"))
    return F.array_join(F.filter(F.transform(blocks, lambda b: _block_text(b, inner)), lambda x: x != ""), "\n")


def text_of(content_json: Column, depth: int = 3) -> Column:
    """Flatten the JSON of host content: a string, or an array of blocks; anything else is ''.

    A string is taken as it is, also if it looks like JSON. Arrays nested deeper than ``depth`` are flattened by a
    function over Arrow batches, which only the rows that have them reach.
    """
    value = F.try_parse_json(content_json)
    kind = F.schema_of_variant(value)
    shallow = F.coalesce(F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(_flat(value, depth)), F.lit(""))
    # each level of blocks has a bracket that opens right after a content key
    nested = F.size(F.split(content_json, r'"content"\s*:\s*\[')) - 1
    return F.when((kind != "STRING") & (nested > depth), _deep_text(content_json)).otherwise(shallow)


@F.arrow_udf(T.StringType())
def _deep_text(content: pa.Array) -> pa.Array:
    def flat(value) -> str:
        if isinstance(value, str):
            return value
        if not isinstance(value, list):
            return ""
        parts = []
        for block in value:
            if isinstance(block, dict):
                text, inner = block.get("text"), block.get("content")
                parts.append(text if isinstance(text, str) else flat(inner))
        return "\n".join(p for p in parts if p)

    return pa.array(["" if x is None else flat(json.loads(x)) for x in content.to_pylist()], pa.string())


def assistant_prose(content_json: Column) -> Column:
    """Text blocks alone, joined by newlines and trimmed."""
    blocks = F.from_json(F.when(content_json.startswith("["), content_json), BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    plain = F.get_json_object(F.concat(F.lit('{"v":'), content_json, F.lit("}")), "$.v")
    return blank_trim(F.coalesce(F.when(content_json.startswith('"'), plain).otherwise(F.array_join(texts, "\n")), F.lit("")))


def fold(text: Column) -> Column:
    """Lower case without marks, letter by letter; in ASCII there are none to look for."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(F.lower(F.translate(text, SPECIAL, FOLDED)), ACCENTED, PLAIN))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; runs of Han as overlapping pairs (one alone stays).

    A text is folded and cut once; only texts with Han letters look at each run.
    """
    folded = fold(text)
    plain = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    runs = F.regexp_extract_all(folded, F.lit(r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^\p{IsHan}") & (F.length(run) > 1), pairs).otherwise(F.array(run))

    return F.coalesce(F.when(~is_ascii(text) & folded.rlike(r"\p{IsHan}"), F.flatten(F.transform(runs, split))).otherwise(plain), F.array().cast("array<string>"))


def query_tokens(text: Column, settings: Settings = DEFAULTS) -> Column:
    """The last tokens of a request; repeats stay."""
    tokens = index_tokens(text)
    n = settings.max_query_tokens
    return F.when(F.size(tokens) <= n, tokens).otherwise(F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), n))


def entry_tokens(entries: DataFrame) -> Column:
    """Size of a host entry by its type; columns type, message_json, summary and content_json."""
    return (
        F.when((F.col("type") == "message") & F.col("message_json").isNotNull(), estimate_tokens_utf16(F.col("message_json")))
        .when(F.col("type").isin("compaction", "branch_summary"), estimate_tokens_utf16(F.col("summary")))
        .when(F.col("type") == "custom_message", estimate_tokens_utf16(F.coalesce("content_json", F.lit('""'))))
        .otherwise(F.lit(0))
        .cast("long")
    )
