"""Mail API payloads to articles, and the mail query.

payloads: source_pos INT, payload STRING (one response per source)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import dates, images, tree
from broadsheet.functions import markup as m
from broadsheet.functions.fold import let
from broadsheet.functions.textops import blank_to_null
from broadsheet.operators import filters, numbering
from broadsheet.sources import registry
from broadsheet.sources.config import option

_RESPONSE = (
    "result string, message string, emails array<struct<subject:string,`from`:string,to:string,html:string,"
    "text:string,timestamp:string,tag:string,attachments:array<string>>>"
)


def sanitize_attrs(html: Column) -> Column:
    """Legal lower-case attribute names only, every element closed."""
    return let(m.map_tokens(html, m.sanitize_attr_names), tree.balance)


def parse(
    payloads: DataFrame, sources: DataFrame | None = None, global_limit: int = fv.DEFAULT_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Mails as articles; a result other than 'success' is a failed run with the response's message.

    With ``sources`` the mail query of every source is applied to its mails.
    """
    read = payloads.select("source_pos", F.from_json("payload", _RESPONSE).alias("r"))
    good = F.coalesce(F.col("r.result") == "success", F.lit(False))
    runs = read.select(
        "source_pos",
        good.alias("success"),
        F.when(~good, F.concat(F.lit("API error: "), F.coalesce("r.message", F.lit("Unknown API error")))).alias("error"),
    )
    mails = read.filter(good).select("source_pos", F.posexplode("r.emails").alias("item_pos", "e"))
    if sources is not None:
        keyed = mails.select("*", F.col("e.tag").alias("tag"), F.col("e.timestamp").try_cast("bigint").alias("timestamp"))
        mails = select_mails(keyed, sources, global_limit)
    e = F.col("e")
    body = F.when(F.coalesce(e["html"], F.lit("")) != "", e["html"]).otherwise(
        F.concat(F.lit("<p>"), F.coalesce(e["text"], F.lit("")), F.lit("</p>"))
    )
    sender = F.coalesce(e["from"], F.lit(""))
    rows = mails.select(
        "source_pos",
        "item_pos",
        F.coalesce(e["subject"], F.lit("No Subject")).alias("title"),
        sanitize_attrs(body).alias("content"),
        F.concat(F.lit("mailto:"), sender).alias("url"),
        sender.alias("author"),
        dates.normalize(e["timestamp"]).alias("published_date"),
        images.extract_raw(body).alias("images"),
        F.create_map(
            F.lit("to"), F.coalesce(e["to"], F.lit("")),
            F.lit("attachments"), F.array_join(F.coalesce(e["attachments"], F.array().cast("array<string>")), ","),
        ).alias("metadata"),
    )
    return registry.as_articles(rows), registry.as_runs(runs)


def query_terms(src: str, metadata: dict | None, global_limit: int = fv.DEFAULT_LIMIT) -> dict:
    """namespace, tag, tag_prefix, timestamp_from, timestamp_to, limit and offset of one mail source."""
    namespace, _, tag = src.replace(" ", "").partition(".")
    metadata = metadata or {}
    given = {k: int(metadata[k]) for k in ("timestamp_from", "timestamp_to") if k in metadata}
    limit = min(int(metadata.get("limit", global_limit)), fv.MAIL_PAGE_LIMIT) if metadata else global_limit
    return {
        "namespace": namespace,
        "tag": metadata.get("tag", tag or None),
        "tag_prefix": metadata.get("tag_prefix"),
        "limit": limit,
        "offset": int(metadata.get("offset", 0)),
        **given,
    }


def terms(sources: DataFrame, global_limit: int = fv.DEFAULT_LIMIT) -> DataFrame:
    """The same for every mail source, as columns; absent conditions are null."""
    meta = F.col("metadata")
    named = F.replace("src", F.lit(" "), F.lit(""))
    limit = F.least(F.coalesce(option(meta, "limit", "int"), F.lit(global_limit)), F.lit(fv.MAIL_PAGE_LIMIT))
    return sources.select(
        "source_pos",
        F.substring_index(named, ".", 1).alias("namespace"),
        F.coalesce(option(meta, "tag"), blank_to_null(F.regexp_extract(named, r"^[^.]*\.(.*)", 1))).alias("_tag"),
        option(meta, "tag_prefix").alias("_prefix"),
        option(meta, "timestamp_from", "bigint").alias("_from"),
        option(meta, "timestamp_to", "bigint").alias("_to"),
        F.coalesce(option(meta, "offset", "int"), F.lit(0)).alias("_offset"),
        F.when(F.size(meta) > 0, limit).otherwise(F.lit(global_limit)).alias("_limit"),
    )


def select_mails(mails: DataFrame, sources: DataFrame, global_limit: int = fv.DEFAULT_LIMIT) -> DataFrame:
    """The mails that each source's query asks for, newest first, numbered anew in ``item_pos``.

    mails: source_pos, item_pos, tag, timestamp (ms).  Equal times keep the order of ``item_pos``.
    """
    asked = terms(sources, global_limit).drop("namespace")
    held = lambda wanted, test: F.col(wanted).isNull() | F.coalesce(test, F.lit(False))
    found = mails.join(asked, "source_pos").filter(
        held("_tag", F.col("tag") == F.col("_tag")) & held("_prefix", F.col("tag").startswith(F.col("_prefix")))
        & held("_from", F.col("timestamp") >= F.col("_from")) & held("_to", F.col("timestamp") <= F.col("_to"))
    )
    upto = F.col("_offset") + F.col("_limit")
    furthest = asked.agg(F.max(upto)).first()[0] or 0
    ordered = found.withColumn("_order", F.struct(-F.coalesce("timestamp", F.lit(-(2**62))), F.col("item_pos"))).withColumn("_upto", upto)
    top = numbering.first_n(ordered, ["source_pos"], "_order", "_upto", int(furthest), number="_rank").filter("_rank > _offset")
    return top.withColumn("item_pos", F.col("_rank") - F.col("_offset") - 1).drop(*asked.columns[1:], "_order", "_upto", "_rank")


@registry.source(
    "mail",
    {
        "metadata.tag": "string", "metadata.tag_prefix": "string", "metadata.timestamp_from": "bigint",
        "metadata.timestamp_to": "bigint", "metadata.limit": "int", "metadata.offset": "int",
    },
)
def adapter(ctx: registry.Context) -> tuple[DataFrame, DataFrame]:
    articles, runs = parse(ctx.landing("mail"), ctx.sources, ctx.global_limit)
    return filters.drop_titles(articles, ctx.sources), runs
