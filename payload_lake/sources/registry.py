"""The endpoint registry: names, paging, id paths and sources of the endpoints whose payloads the lake holds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, scope string, paging string, source_endpoint string, needs_credential boolean, id_paths array<string>, items_path string, place int"


class Endpoint(NamedTuple):
    """``scope`` is account or item; an item endpoint is asked for every item that ``source`` lists."""

    name: str
    scope: str
    paging: str
    source: str | None = None
    needs_credential: bool = False
    id_paths: tuple[str, ...] = ()
    items_path: str | None = None


#: fixed values, in catalogue order
CATALOGUE = [
    Endpoint("user_info", "account", "none"),
    Endpoint("videos", "account", "page", id_paths=("list.vlist[*].bvid",), items_path="list.vlist"),
    Endpoint("access_id", "account", "none"),
    Endpoint("relation_info", "account", "none"),
    Endpoint("up_stat", "account", "none"),
    Endpoint("overview_stat", "account", "none"),
    Endpoint("articles", "account", "page", id_paths=("articles[*].id",), items_path="articles"),
    Endpoint("subscribed_bangumi", "account", "page", id_paths=("list[*].season_id",), items_path="list"),
    Endpoint("opus", "account", "cursor", id_paths=("items[*].opus_id",), items_path="items"),
    Endpoint("dynamics", "account", "cursor", id_paths=("items[*].id_str",), items_path="items"),
    Endpoint("audios", "account", "page", id_paths=("data[*].id",), items_path="data"),
    Endpoint("channel_list", "account", "page", id_paths=("items_lists.seasons_list[*].meta.season_id", "items_lists.series_list[*].meta.series_id"), items_path="items_lists"),
    Endpoint("channels", "account", "none"),
    Endpoint("media_list", "account", "oid", id_paths=("media_list[*].bvid", "list[*].bvid", "items[*].bvid"), items_path="media_list"),
    Endpoint("video_detail", "item", "none", source="videos"),
    Endpoint("video_pages", "item", "none", source="videos"),
    Endpoint("video_detail_full", "item", "none", source="videos"),
    Endpoint("video_ai_conclusion", "item", "none", source="videos"),
    Endpoint("video_danmaku_snapshot", "item", "none", source="videos"),
    Endpoint("video_danmaku_view", "item", "none", source="videos"),
    Endpoint("video_danmaku_xml", "item", "none", source="videos"),
    Endpoint("video_danmakus", "item", "none", source="videos"),
    Endpoint("video_online", "item", "none", source="videos"),
    Endpoint("video_pay_coins", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_pbp", "item", "none", source="videos"),
    Endpoint("video_player_info", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_private_notes", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_public_notes", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_related", "item", "none", source="videos"),
    Endpoint("video_relation", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_special_dms", "item", "none", source="videos"),
    Endpoint("video_subtitle", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_up_mid", "item", "none", source="videos"),
    Endpoint("video_snapshot", "item", "none", source="videos"),
    Endpoint("video_download_url", "item", "none", source="videos"),
    Endpoint("video_is_episode", "item", "none", source="videos"),
    Endpoint("video_is_forbid_note", "item", "none", source="videos", needs_credential=True),
    Endpoint("video_chargers", "item", "none", source="videos"),
    Endpoint("article_detail", "item", "none", source="articles"),
    Endpoint("opus_detail", "item", "none", source="opus"),
    Endpoint("article_list_detail", "item", "none", source="article_list"),
    Endpoint("user_medal", "account", "none", needs_credential=True),
    Endpoint("live_info", "account", "none"),
    Endpoint("user_relation", "account", "none", needs_credential=True),
    Endpoint("reservation", "account", "none"),
    Endpoint("uplikeimg", "account", "none", needs_credential=True),
    Endpoint("top_followers", "account", "none"),
    Endpoint("space_notice", "account", "none"),
    Endpoint("all_followings", "account", "none", needs_credential=True),
    Endpoint("followings", "account", "page", needs_credential=True, id_paths=("list[*].mid",), items_path="list"),
    Endpoint("followers", "account", "page", needs_credential=True, id_paths=("list[*].mid",), items_path="list"),
    Endpoint("same_followers", "account", "page", needs_credential=True, id_paths=("list[*].mid",), items_path="list"),
    Endpoint("top_videos", "account", "none"),
    Endpoint("masterpiece", "account", "none"),
    Endpoint("article_list", "account", "none"),
    Endpoint("cheese", "account", "none"),
    Endpoint("elec_monthly", "account", "none", needs_credential=True),
    Endpoint("user_fav_tag", "account", "page"),
    Endpoint("album", "account", "page", items_path="biz_list"),
    Endpoint("channel_videos_season", "item", "none", source="channel_list"),
    Endpoint("channel_videos_series", "item", "none", source="channel_list"),
    Endpoint("upower_qa", "account", "anchor", needs_credential=True, id_paths=("list[*].qa_id",), items_path="list"),
    Endpoint("upower_qa_detail", "item", "none", source="upower_qa", needs_credential=True),
]


def endpoint_registry(spark: SparkSession) -> DataFrame:
    """One row per endpoint; ``place`` is its place in the catalogue."""
    rows = [(e.name, e.scope, e.paging, e.source, e.needs_credential, list(e.id_paths), e.items_path, place) for place, e in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, SCHEMA)
