"""Declared schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _of(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, L, T, I = StringType(), LongType(), TimestampType(), IntegerType()  # noqa: E741

#: The stored logs; every change is a row that is added.
LOGS = {
    # (user_id, card_type) last wins
    "draws": _of(user_id=S, card_name=S, times=T, card_type=S),
    # image_name last wins
    "votes": _of(id=L, owner_user_id=S, image_name=S, vote_result=S, vote_time=T, voters=_of(agree=ArrayType(S), disagree=ArrayType(S), abstain=ArrayType(S))),
    # (user_id, old_image_name) first wins
    "renames": _of(user_id=S, old_image_name=S, new_image_name=S, rename_time=T),
    "moves": _of(id=L, user_id=S, command=S, moved_images=S, usage_time=T, card_type=S),
    "history": _of(user_id=S, card_type=S, history=S, total_count=L, last_draw_time=T),
    "users": _of(user_id=S, read_help=I),
}
#: An entry of ``history``, as JSON in a list.
HISTORY_ENTRY = ArrayType(_of(timestamp=S, card_name=S))
ALIASES = _of(position=I, name=S, aliases=ArrayType(S), short_name=S, en_name=S)
