"""Routing of chat messages to commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.text import trimmed

# The commands, each with how it matches and its text.
COMMANDS = [
    ("draw_a", "regex", r"^抽(?!.*老公).*老婆.*$"),
    ("view_a", "exact", "查看老婆"),
    ("rename_a", "prefix", "老婆改名"),
    ("share_a", "prefix", "老婆概率"),
    ("move_b_to_a", "exact", "这是男的"),
    ("draw_b", "regex", r"^抽(?!.*老婆).*老公.*$"),
    ("view_b", "exact", "查看老公"),
    ("rename_b", "prefix", "老公改名"),
    ("share_b", "prefix", "老公概率"),
    ("move_a_to_b", "exact", "这是女的"),
    ("vote", "prefix", "投票删除"),
    ("help", "exact", "帮助抽游戏立绘"),
]


def command(message: Column) -> Column:
    """The first command that a message matches, or null."""
    out = None
    for name, how, text in COMMANDS:
        hit = message.rlike(text) if how == "regex" else message == text if how == "exact" else F.startswith(message, F.lit(text))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def argument(message: Column) -> Column:
    """What follows the prefix of a rename, share or vote command, trimmed; null for other messages and where nothing follows."""
    out = F.lit(None).cast("string")
    for _, how, text in reversed(COMMANDS):
        if how == "prefix":
            out = F.when(F.startswith(message, F.lit(text)), trimmed(F.substring(message, len(text) + 1, 2**31 - 1))).otherwise(out)
    return F.when(out != "", out)


def reply_mode(images: Column) -> Column:
    """How a reply is sent: more than two images as a forwarded bundle, else in line."""
    return F.when(images > 2, "forward").otherwise("inline")


def gate(ready: Column, accepted: Column, pending: Column) -> Column:
    """The first gate that stops a command, or "pass": model ready, terms accepted, confirmation pending."""
    return F.when(~ready, "model_not_ready").when(accepted, "pass").when(pending, "confirmation_pending").otherwise("ask_terms")


def is_muted(until_epoch: Column, now: Column) -> Column:
    """Is a mute that ends at ``until_epoch`` (0 or null: none) still on?"""
    return F.coalesce(until_epoch, F.lit(0)) > F.unix_timestamp(now)
