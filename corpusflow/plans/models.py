"""Deterministic model functions used by the registered inference queries.

They stand in for a chat model so that results can be restated in SQL:
pure functions of the rendered request, no network.
"""

from __future__ import annotations

from corpusflow import constants as K


def _text_of(user: str) -> str:
    """The document part of a rendered user message."""
    i = user.find(K.USER_TEMPLATE_MID)
    return user[i + len(K.USER_TEMPLATE_MID):] if i >= 0 else user


def echo_model(req: dict) -> str:
    """``<length of the user message>|<its last 40 characters>`` (then stripped)."""
    u = req["user"]
    return f"{len(u)}|{u[-40:]}"


class Unreachable(ConnectionError):
    pass


def flaky_model(req: dict) -> str:
    """Outcome by the first character of the document text:
    ``T`` -> connection error (retried, then marked failed); ``E`` -> blank
    answer; ``S`` -> an answer that mentions failure; otherwise ``ok:<len>``."""
    first = _text_of(req["user"])[:1]
    if first == "T":
        raise Unreachable("no route to model")
    if first == "E":
        return "   "
    if first == "S":
        return f"本次失败 {len(req['user'])}"
    return f"ok:{len(req['user'])}"


class Killed(BaseException):
    """Ends a task as a lost machine would: no retry policy sees it."""


def killed_model(req: dict) -> str:
    """The echo, until a request of a certain length ends the task."""
    if len(req["user"]) % 211 == 5:
        raise Killed()
    return echo_model(req)


def failing_model(req: dict) -> str:
    """A model that is down for every other length."""
    if len(req["user"]) % 2:
        raise Unreachable("no route to model")
    return echo_model(req)


def writing_model(req: dict) -> str:
    """A reverse-prompt model: a request naming the size of what it saw."""
    u = req["user"]
    return f"写一段{len(u)}字的故事，max_tokens={req['max_tokens']}"


def revision_model(req: dict) -> str:
    """Revision request for the first request kind, a plainer text for the second;
    blank for requests whose text starts with ``E`` (tests the fallbacks)."""
    u = req["user"]
    body = _text_of(u)
    if body.startswith("E"):
        return ""
    if u.startswith(K.USER_TEMPLATE_HEAD + K.SIMPLIFY_PROMPT):
        return f"简化:{body[:30]}"
    return f"请润色 {len(u)}"


def no_sleep(_seconds: float) -> None:
    return None
