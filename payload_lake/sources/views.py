"""Fields of the typed views of the documented payloads (fixed values).

Times ending in ``_s`` are seconds since the epoch.
"""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    """A column of a view: the first of its paths that has a value counts."""

    name: str
    type: str
    paths: tuple[str, ...]


class Listing(NamedTuple):
    """Where the rows of a payload are: in its pages or in itself, at a path; and their fields."""

    paged: bool
    path: str
    fields: list[Field]


def field(name: str, kind: str, *paths: str) -> Field:
    """A field at the path of its own name if no other is given."""
    return Field(name, kind, paths or (name,))


VIDEO_ROW = [
    field("aid", "bigint"),
    field("bvid", "string"),
    field("title", "string"),
    field("description", "string"),
    field("author", "string"),
    field("mid", "bigint"),
    field("created_s", "bigint", "created"),
    field("length", "string"),
    field("play", "bigint"),
    field("video_review", "bigint"),
    field("comment", "bigint"),
    field("favorites", "bigint"),
    field("typeid", "bigint"),
]
STATS = [
    field("views", "bigint", "stats.view"),
    field("likes", "bigint", "stats.like"),
    field("replies", "bigint", "stats.reply"),
    field("favorites", "bigint", "stats.favorite"),
    field("shares", "bigint", "stats.share"),
    field("coins", "bigint", "stats.coin"),
]
COLLECTION = [
    field("id", "bigint"),
    field("mid", "bigint"),
    field("name", "string"),
    field("summary", "string"),
    field("article_count", "bigint"),
    field("read_count", "bigint"),
    field("words", "bigint"),
    field("state", "bigint"),
    field("created_s", "bigint", "ctime"),
    field("updated_s", "bigint", "update_time"),
    field("published_s", "bigint", "publish_time"),
]

#: one row for each payload
SINGLE = {
    "user_info": [
        field("mid", "bigint"),
        field("name", "string"),
        field("sex", "string"),
        field("face", "string"),
        field("sign", "string"),
        field("birthday", "string"),
        field("level", "bigint"),
        field("joined_s", "bigint", "jointime"),
        field("vip_type", "bigint", "vip.type"),
        field("vip_status", "bigint", "vip.status"),
        field("vip_label", "string", "vip.label.text", "vip.label"),
    ],
    "relation_info": [
        field("mid", "bigint"),
        field("following", "bigint"),
        field("follower", "bigint"),
        field("whisper", "bigint"),
        field("black", "bigint"),
    ],
    "up_stat": [
        field("archive_views", "bigint", "archive.view", "archive"),
        field("article_views", "bigint", "article.view", "article"),
        field("likes", "bigint"),
    ],
    "overview_stat": [
        field("videos", "bigint", "video.video_count", "video_count", "video"),
        field("articles", "bigint", "article.article_count", "article_count", "article"),
        field("opus", "bigint", "opus.opus_count", "opus_count", "opus"),
        field("album", "bigint"),
        field("fav", "bigint"),
        field("bangumi", "bigint"),
        field("season", "bigint"),
        field("series", "bigint"),
    ],
    "elec_monthly": [
        field("show_info", "bigint"),
        field("total", "bigint"),
        field("count", "bigint"),
    ],
    "space_notice": [
        field("text", "string", ""),
    ],
    "video_detail": [
        field("bvid", "string", "info.bvid"),
        field("title", "string", "info.title"),
        field("duration_s", "bigint", "info.duration"),
        field("published_s", "bigint", "info.pubdate"),
        field("owner_mid", "bigint", "info.owner.mid"),
        field("owner_name", "string", "info.owner.name"),
        field("views", "bigint", "info.stat.view"),
    ],
    "article_detail": [
        field("id", "bigint", "info.id"),
        field("title", "string", "info.title"),
        field("published_s", "bigint", "info.publish_time"),
        field("words", "bigint", "info.words"),
        field("summary", "string", "info.summary"),
        field("author_mid", "bigint", "info.author.mid"),
        field("markdown", "string"),
    ],
    "opus_detail": [
        field("comment_id", "string", "info.item.basic.comment_id_str"),
        field("comment_type", "bigint", "info.item.basic.comment_type"),
        field("rid", "string", "info.item.basic.rid_str"),
        field("markdown", "string"),
    ],
}

LISTINGS = {
    "videos": Listing(True, "list.vlist", VIDEO_ROW),
    "articles": Listing(
        True, "articles", [
            field("id", "bigint"),
            field("title", "string"),
            field("summary", "string"),
            field("published_s", "bigint", "publish_time"),
            field("created_s", "bigint", "ctime"),
            field("template_id", "bigint"),
            field("kind", "bigint", "type"),
            field("author_mid", "bigint", "author.mid"),
            *STATS,
        ]
    ),
    "opus": Listing(
        True, "items", [
            field("id", "string", "opus_id"),
            field("title", "string"),
            field("summary", "string"),
            field("published_s", "bigint", "pub_time"),
            field("created_s", "bigint", "ctime"),
            field("kind", "string", "type"),
            *STATS,
        ]
    ),
    "dynamics": Listing(
        True, "items", [
            field("id", "string", "id_str"),
            field("kind", "string", "type"),
            field("visible", "boolean"),
            field("author_mid", "bigint", "modules.module_author.mid", "modules[0].module_author.mid"),
            field("published_s", "bigint", "modules.module_author.pub_ts", "modules[0].module_author.pub_ts"),
            field("text", "string", "modules.module_dynamic.desc.text"),
            field("major", "string", "modules.module_dynamic.major.type"),
            field("bvid", "string", "modules.module_dynamic.major.archive.bvid"),
        ]
    ),
    "audios": Listing(
        True, "data", [
            field("id", "bigint"),
            field("uid_of", "bigint", "uid"),
            field("author", "string"),
            field("title", "string"),
            field("intro", "string"),
            field("duration_s", "bigint", "duration"),
            field("created_s", "bigint", "ctime"),
            field("play", "bigint", "statistic.play"),
            field("comment", "bigint", "statistic.comment"),
        ]
    ),
    "channel_list_seasons": Listing(
        True, "items_lists.seasons_list", [
            field("season_id", "string", "meta.season_id"),
            field("mid", "bigint", "meta.mid"),
            field("name", "string", "meta.name"),
            field("total", "bigint", "meta.total"),
            field("published_s", "bigint", "meta.ptime"),
            field("archive_count", "bigint"),
        ]
    ),
    "channel_list_series": Listing(
        True, "items_lists.series_list", [
            field("series_id", "string", "meta.series_id"),
            field("mid", "bigint", "meta.mid"),
            field("name", "string", "meta.name"),
            field("total", "bigint", "meta.total"),
            field("created_s", "bigint", "meta.ctime"),
            field("changed_s", "bigint", "meta.mtime"),
            field("archive_count", "bigint"),
        ]
    ),
    "subscribed_bangumi": Listing(
        True, "list", [
            field("season_id", "bigint"),
            field("media_id", "bigint"),
            field("season_type", "bigint"),
            field("title", "string"),
            field("total_count", "bigint"),
            field("is_finish", "bigint"),
            field("subtitle", "string"),
            field("progress", "string"),
            field("follow_status", "bigint"),
        ]
    ),
    "album": Listing(
        True, "biz_list", [
            field("doc_id", "bigint"),
            field("poster_uid", "bigint"),
            field("title", "string"),
            field("description", "string"),
            field("category", "string"),
            field("uploaded_s", "bigint", "upload_time"),
            field("like_num", "bigint"),
            field("comment_num", "bigint"),
            field("view_num", "bigint"),
        ]
    ),
    "user_fav_tag": Listing(
        True, "list", [
            field("tag_id", "bigint"),
            field("name", "string"),
            field("kind", "bigint", "type"),
            field("count", "bigint"),
            field("created_s", "bigint", "ctime"),
            field("is_activity", "boolean"),
            field("is_atten", "bigint"),
        ]
    ),
    "upower_qa": Listing(
        True, "list", [
            field("qa_id", "string"),
            field("question", "string"),
            field("answer", "string"),
            field("created_s", "bigint", "ctime"),
            field("changed_s", "bigint", "mtime"),
            field("state", "bigint"),
            field("order_num", "bigint"),
        ]
    ),
    "article_list": Listing(False, "lists", COLLECTION),
    "all_followings": Listing(
        False, "", [
            field("mid", "bigint"),
            field("name", "string", "uname"),
            field("attribute", "bigint"),
            field("special", "bigint"),
            field("sign", "string"),
        ]
    ),
    "top_videos": Listing(False, "list", VIDEO_ROW),
    "masterpiece": Listing(
        False, "list", [
            field("aid", "bigint"),
            field("bvid", "string"),
            field("title", "string"),
            field("description", "string"),
            field("play", "bigint"),
            field("video_review", "bigint"),
            field("comment", "bigint"),
            field("reason", "string"),
            field("reason_type", "bigint"),
        ]
    ),
    "cheese": Listing(
        False, "items", [
            field("season_id", "bigint"),
            field("title", "string"),
        ]
    ),
    "article_list_detail": Listing(
        False, "articles", [
            field("id", "bigint"),
            field("title", "string"),
            field("summary", "string"),
            field("published_s", "bigint", "publish_time"),
            field("created_s", "bigint", "ctime"),
            field("words", "bigint"),
            *STATS,
        ]
    ),
    "channel_videos_season": Listing(False, "archives", VIDEO_ROW),
    "channel_videos_series": Listing(False, "archives", VIDEO_ROW),
}
#: listings that are views of another endpoint's payload
OF_ENDPOINT = {"channel_list_seasons": "channel_list", "channel_list_series": "channel_list"}
