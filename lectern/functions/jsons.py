"""JSON of loose origin (options, model answers) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import WS, shortened, strip


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed(options: Column | str) -> Column:
    """Variant of a JSON text; of ``{}`` where it is NULL or empty; NULL where
    it is invalid."""
    o = _c(options)
    return F.try_parse_json(F.coalesce(F.nullif(o, F.lit("")), F.lit("{}")))


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def strict_int(v: Column, key: str, least: int | None = None) -> Column:
    """An integer of a variant; strings, booleans and fractions are none."""
    got = F.when(_kind(v, key) == "BIGINT", F.try_variant_get(v, f"$.{key}", "bigint"))
    return got if least is None else F.when(got >= least, got)


def strict_text(v: Column, key: str) -> Column:
    """A string that isn't blank, stripped."""
    return F.when(_kind(v, key) == "STRING", F.nullif(strip(F.try_variant_get(v, f"$.{key}", "string")), F.lit("")))


def truthy(v: Column, key: str, missing: bool = True) -> Column:
    """Truth of a value: null, 0, "", [] and {} are false."""
    kind = _kind(v, key)
    value = F.try_variant_get(v, f"$.{key}", "string")
    return (
        F.when(kind.isNull(), F.lit(missing))
        .when(kind == "BOOLEAN", value == "true")
        .when(kind == "VOID", F.lit(False))
        .otherwise(~F.coalesce(value, F.lit("")).isin("", "0", "0.0", "[]", "{}"))
    )


def revision(v: Column, key: str) -> Column:
    """Revision recorded in options: 0 where missing, NULL where invalid."""
    return F.when(_kind(v, key).isNull(), F.lit(0).cast("bigint")).otherwise(strict_int(v, key, 0))


def json_body(answer: Column | str) -> Column:
    """The JSON of a model's answer: out of a fenced block, then from the first
    opening brace to the last closing one."""
    s = strip(_c(answer))
    fenced = F.regexp_replace(F.regexp_replace(s, r"(?s)^```[^\n]*\n?", ""), r"(?s)\n?```[^\n]*\z", "")
    s = F.when(s.startswith("```"), strip(fenced)).otherwise(s)
    braces = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(s)


def clean_tag(tag: Column, most: int | None = 16) -> Column:
    """Without marks, without white space, cut to ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(strip(tag), "^[#＃]+", ""), r"[#＃]+\z", "")
    t = F.regexp_replace(t, rf"[{WS}]+", "")
    return t if most is None else F.left(t, F.lit(most))


def distinct_tags(tags: Column, most: int | None = 16, limit: int | None = None) -> Column:
    """Clean tags that aren't empty, the first of equal ones."""
    got = F.array_distinct(F.filter(F.transform(tags, lambda t: clean_tag(t, most)), lambda t: F.coalesce(t, F.lit("")) != ""))
    return got if limit is None else F.slice(got, 1, limit)


def answer_tags(answer: Column | str, limit: int = 10) -> Column:
    """Tags of a model's answer: a JSON object's ``tags``, a JSON array, or a
    plain list of words."""
    body = json_body(answer)
    from_object = F.from_json(F.get_json_object(body, "$.tags"), "array<string>")
    from_array = F.from_json(body, "array<string>")
    plain = F.split(body, "[,，、\n]+")
    valid = F.try_parse_json(body).isNotNull()
    tags = (
        F.when(valid & body.startswith("{"), F.coalesce(from_object, F.array().cast("array<string>")))
        .when(valid & body.startswith("["), F.coalesce(from_array, F.array().cast("array<string>")))
        .when(valid, F.array().cast("array<string>"))
        .otherwise(plain)
    )
    return distinct_tags(tags, 16, limit)


def answer_field(answer: Column | str, key: str) -> Column:
    """A string of the JSON object of a model's answer, else NULL."""
    return strict_text(F.try_parse_json(json_body(answer)), key)


def chat_content(response: Column | str) -> Column:
    """Text of a chat completion; NULL if it isn't a string or blank."""
    v = F.try_parse_json(_c(response))
    ok = F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant")) == "STRING"
    return F.when(ok, F.nullif(strip(F.try_variant_get(v, "$.choices[0].message.content", "string")), F.lit("")))


def speech_audio(response: Column | str) -> Column:
    """(audio BINARY, error STRING) of a speech completion: base64 data that
    must decode to RIFF/WAVE bytes."""
    v = F.try_parse_json(_c(response))
    data = F.try_variant_get(v, "$.choices[0].message.audio.data", "string")
    raw = F.try_to_binary(data, F.lit("base64"))
    magic = (F.substring(raw, 1, 4) == F.lit(b"RIFF")) & (F.substring(raw, 9, 4) == F.lit(b"WAVE"))
    error = (
        F.when(v.isNull(), "invalid response")
        .when(F.coalesce(data, F.lit("")) == "", "missing audio")
        .when(raw.isNull(), "invalid base64")
        .when(F.octet_length(raw) == 0, "empty audio")
        .when(~F.coalesce(magic, F.lit(False)), "not a WAV file")
    )
    return F.struct(F.when(error.isNull(), raw).alias("audio"), error.alias("error"))


def error_text(code: Column, reason: Column, body: Column) -> Column:
    """Message of a failed call: the error's own text, else what is known."""
    v = F.try_parse_json(body)
    own = strict_text(v, "error.message")
    return F.when(v.isNull(), F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), body)).otherwise(
        F.coalesce(own, F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), reason))
    )


def retry_after(value: Column, now: Column | None = None) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date from ``now``
    on; never negative, NULL where it is neither."""
    number = F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*\z"), F.trim(value).cast("double"))
    at = F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    left = F.unix_timestamp(at) - F.unix_timestamp(F.current_timestamp() if now is None else now)
    return F.coalesce(number, F.when(left.isNotNull(), F.greatest(F.lit(0.0), left.cast("double"))))


def retry_delay(attempt: Column, header: Column, most: float = 30.0, now: Column | None = None) -> Column:
    """Seconds to wait: as asked for, else doubling, at most ``most``."""
    return F.least(F.lit(most), F.coalesce(retry_after(header, now), F.pow(F.lit(2.0), attempt)))


def bounded_parallel(asked: Column, most: Column) -> Column:
    """Workers to run; NULL where fewer than one were asked for."""
    top = F.greatest(F.lit(1), most)
    return F.when(asked.isNull(), top).when(asked >= 1, F.least(asked, top))


def text_list(value: Column | str) -> Column:
    """(items, error) of a JSON list of texts, stripped, blank ones dropped; an
    item that is no text, or a value that is no list, is an error."""
    v = F.try_parse_json(_c(value))
    kinds = F.from_json(_c(value), "array<string>")
    items = F.try_variant_get(v, "$", "array<variant>")
    bad = F.array_position(F.transform(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"), F.lit(True))
    kept = F.filter(F.transform(kinds, strip), lambda x: x != "")
    error = F.when(_c(value).isNull() | (F.schema_of_variant(v) == "VOID"), None).when(items.isNull(), "must be a list of text values").when(bad > 0, F.format_string("[%d] must be text", bad - 1))
    empty = F.array().cast("array<string>")
    return F.struct(F.when(error.isNull(), F.coalesce(kept, empty)).alias("items"), error.alias("error"))


def stored_tags(value: Column | str) -> Column:
    """Tags of a JSON list, each as text, stripped, blank ones dropped; none where
    the value is no list."""
    items = F.try_variant_get(F.try_parse_json(_c(value)), "$", "array<variant>")
    texts = F.transform(items, lambda x: strip(F.coalesce(x.cast("string"), F.lit("None"))))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def overridden(options: Column, key: Column | str, value: Column | str) -> Column:
    """A copy of a map with one entry set."""
    k = F.lit(key) if isinstance(key, str) else key
    rest = F.map_filter(options, lambda a, _: a != k)
    return F.map_concat(rest, F.create_map(k, F.lit(value) if isinstance(value, str) else value))


def linear_delay(attempt: Column, step: float = 0.1) -> Column:
    """Seconds to wait after the attempt of that number, counted from 0."""
    return F.lit(step) * (attempt + 1)


def attempts(retries: Column) -> Column:
    return F.lit(1) + F.greatest(F.lit(0), retries)


def response_summary(response: Column | str, most: int = 240) -> Column:
    """What a response without sound held, in short, for its error message."""
    v = F.try_parse_json(_c(response))
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    choice, message, audio = at("$.choices[0]", "variant"), at("$.choices[0].message", "variant"), at("$.choices[0].message.audio", "variant")
    there = lambda x: x.isNotNull() & (F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "VOID")
    short = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}="), shortened(x, most)))
    keys = lambda x: F.array_join(F.array_sort(F.map_keys(F.from_json(F.to_json(x), "map<string,string>"))), ",")
    message_keys = keys(message)
    told = F.concat_ws(
        "; ",
        short("finish_reason", at("$.choices[0].finish_reason")), short("content", at("$.choices[0].message.content")), short("refusal", at("$.choices[0].message.refusal")),
        F.when(~there(audio), "audio=None").otherwise(F.concat(F.lit("audio_keys="), F.coalesce(F.nullif(keys(audio), F.lit("")), F.lit("empty")))),
        F.when(message_keys != "", F.concat(F.lit("message_keys="), message_keys)),
    )
    none = F.concat_ws("; ", short("finish_reason", at("$.choices[0].finish_reason")), F.lit("message=missing"))
    return F.when(~there(choice), "type=dict; choices=missing").when(~there(message), none).otherwise(told)
