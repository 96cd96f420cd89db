"""Assistant conversations recovered from cached responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import times
from caseloom.functions.core import any_of, blank_to_null, first_present, text, with_computed
from caseloom.operators import ordered
from caseloom.plans.common import HOST
from caseloom.sources.raw import SCAN_TIES

# Hosts looked for and the provider behind each.
WATCHED_HOSTS = ["chatgpt.com", "chat.openai.com", "openai.com", "claude.ai", "anthropic.com", "gemini.google.com", "bard.google.com"]
PROVIDER_HOSTS = {
    "chatgpt.com": "ChatGPT", "chat.openai.com": "ChatGPT", "claude.ai": "Claude",
    "gemini.google.com": "Gemini", "bard.google.com": "Gemini",
}
MESSAGE = "struct<role:string,text:string,time:string>"


def provider(url: Column | str) -> Column:
    host = F.lower(F.get(F.split(F.col(url) if isinstance(url, str) else url, "/"), F.lit(2)))
    found = F.when(F.lit(False), F.lit(""))
    for name, label in PROVIDER_HOSTS.items():
        found = found.when(host == name, label)
    return found


def _is(value: Column, path: str, kind: str) -> Column:
    """Whether a payload path holds an object or an array."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")).startswith(kind), F.lit(False))


def is_conversation(provider_name: Column, url: Column, payload: Column) -> Column:
    """Only the providers' conversation endpoints with their own payload shape count."""
    endpoint = F.regexp_replace(F.regexp_extract(url, r"^([^?]*)", 1), "/+$", "")
    chat_id = F.regexp_extract(endpoint, r"/backend-api/conversation/([^/]+)$", 1)
    chatgpt = (provider_name == "ChatGPT") & (chat_id != "") & _is(payload, "$.mapping", "OBJECT")
    claude = (provider_name == "Claude") & endpoint.contains("/chat_conversations/") & (
        _is(payload, "$.chat_messages", "ARRAY") | _is(payload, "$.messages", "ARRAY"))
    gemini = (provider_name == "Gemini") & endpoint.contains("BardFrontendService/GetConversation") & (
        _is(payload, "$.conversation", "OBJECT") | _is(payload, "$.messages", "ARRAY"))
    return chatgpt | claude | gemini


def time_field(payload: Column, names: list[str]) -> Column:
    """First present name; text or number as text, anything else blank."""
    values = [F.try_variant_get(payload, f"$.{n}", "variant") for n in names]
    first = F.coalesce(*values)
    plain = ~F.schema_of_variant(first).rlike("^(OBJECT|ARRAY|BOOLEAN)")
    return F.when(plain, blank_to_null(F.try_variant_get(first, "$", "string")))


def observation_time() -> Column:
    return first_present("response_time", "request_time", "creation_time")


def conversations(cache: DataFrame, keys: list[str] = HOST, start: str | None = None, end: str | None = None,
                  per_source: int | None = None) -> DataFrame:
    """Conversations in cached JSON bodies. Cheap tests on host and type run before any body is decoded."""
    low = F.lower(text("url"))
    rows = cache.filter(
        (text("body_b64") != "") & F.lower(text("content_type")).contains("json") & any_of([low.contains(h) for h in WATCHED_HOSTS])
    )
    if per_source is not None:
        rows = ordered.top_per_key(rows, [*keys, "_source_file"], [F.col("_rowid")], per_source)
    rows = rows.withColumn("date", observation_time())
    if start:
        rows = rows.filter(text("date") >= start)
    if end:
        rows = rows.filter(text("date") <= end)
    body = F.try_validate_utf8(F.try_to_binary("body_b64", F.lit("base64")).cast("string"))
    clean = F.regexp_replace(body, r"^[)\]'\n\r ]+", "")
    parsed = with_computed(rows.withColumn("provider", provider("url")).filter(F.col("provider").isNotNull()), "payload", F.try_parse_json(clean))
    known = parsed.filter(F.col("payload").isNotNull() & is_conversation(F.col("provider"), F.col("url"), F.col("payload")))
    has_title = F.try_variant_get("payload", "$.title", "variant").isNotNull()
    titled = F.when(has_title, F.try_variant_get("payload", "$.title", "variant")).otherwise(F.try_variant_get("payload", "$.name", "variant"))
    return known.select(
        *keys, *SCAN_TIES, "provider", "account",
        F.when(F.schema_of_variant(titled) == "STRING", F.try_variant_get(titled, "$", "string")).alias("title"),
        "date", time_field(F.col("payload"), ["create_time", "created_at"]).alias("created_at"),
        time_field(F.col("payload"), ["update_time", "updated_at"]).alias("updated_at"), "url", "payload",
    )


def conversation_order() -> list[Column]:
    return [F.desc(text("date")), F.asc("url")]


def _string(value: Column, path: str) -> Column:
    inner = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(value, path, "string"))


def _message(role: Column, body: Column, time: Column) -> Column:
    return F.struct(F.coalesce(blank_to_null(role), F.lit("?")).alias("role"), body.alias("text"), times.payload_time(time).alias("time"))


def _scalar(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def messages(found: DataFrame, keys: list[str]) -> DataFrame:
    """Messages of every conversation as rows, from the three payload shapes, in conversation order."""
    v = F.col("payload")
    list_of = lambda value, path: F.try_variant_get(value, path, "array<variant>")

    def mapping_message(node: Column) -> Column:
        parts = list_of(node, "$.message.content.parts")
        joined = F.array_join(
            F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.to_json(p))), "\n"
        )
        body = F.when(_is(node, "$.message.content.parts", "ARRAY"), joined).otherwise(_scalar(node, "$.message.content.text"))
        at = F.coalesce(F.try_variant_get(node, "$.message.create_time", "double"), F.lit(0.0))
        return F.struct(at.alias("at"), _message(_scalar(node, "$.message.author.role"), body, _scalar(node, "$.message.create_time")).alias("m"))

    nodes = F.map_values(F.try_variant_get(v, "$.mapping", "map<string,variant>"))
    nodes = F.filter(nodes, lambda n: text(_scalar(n, "$.message.author.role")) != "")
    # Document order breaks ties of the message time.
    placed = F.transform(nodes, lambda n, i: F.struct(mapping_message(n)["at"].alias("at"), i.alias("i"), mapping_message(n)["m"].alias("m")))
    from_mapping = F.transform(F.array_sort(placed), lambda x: x["m"])

    def chat_message(item: Column) -> Column:
        pieces = F.array_join(F.transform(list_of(item, "$.content"), lambda p: text(_scalar(p, "$.text"))), "\n")
        body = F.coalesce(blank_to_null(_scalar(item, "$.text")), pieces)
        role = first_present(_scalar(item, "$.sender"), _scalar(item, "$.role"))
        return _message(role, body, _scalar(item, "$.created_at"))

    def generic_message(item: Column) -> Column:
        parts = F.coalesce(list_of(item, "$.parts"), list_of(item, "$.content.parts"))
        texts = F.transform(parts, lambda p: F.coalesce(_string(p, "$"), _scalar(p, "$.text")))
        joined = F.array_join(F.filter(texts, lambda t: text(t) != ""), "\n")
        own = F.coalesce(_string(item, "$.text"), _string(item, "$.content"))
        role = F.coalesce(_scalar(item, "$.role"), _scalar(item, "$.sender"), _scalar(item, "$.author.role"))
        return _message(role, F.coalesce(blank_to_null(own), joined), _scalar(item, "$.created_at"))

    none = F.array().cast(f"array<{MESSAGE}>")
    generic = F.coalesce(list_of(v, "$.messages"), list_of(v, "$.contents"), list_of(v, "$.turns"))
    objects = F.filter(generic, lambda g: F.schema_of_variant(g).startswith("OBJECT"))
    every = F.concat(
        F.coalesce(from_mapping, none),
        F.coalesce(F.transform(list_of(v, "$.chat_messages"), chat_message), none),
        F.coalesce(F.transform(objects, generic_message), none),
    )
    spoken = F.filter(every, lambda m: F.trim(text(m["text"])) != "")
    return found.select(*keys, F.posexplode(spoken).alias("position", "m")).select(*keys, "position", "m.*")
