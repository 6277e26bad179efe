"""Calls to slow services from inside a task: several at a time, in order, with retries and a time limit."""

import queue
import time
from collections import deque
from collections.abc import Callable, Iterable
from threading import Thread
from typing import NamedTuple


class Reply(NamedTuple):
    value: object
    error: str | None
    seconds: float


def _error(failure: Exception) -> str:
    return str(failure) or type(failure).__name__


def ask_all(call: Callable, requests: Iterable[tuple], width: int = 1, limit: float | None = None, retries: int = 0) -> list[Reply]:
    """The reply to ``call(*request)`` for each request, in their order; a failure is a reply with its error.

    At most ``width`` calls run at a time. A failed call is made again up to ``retries`` times, after the requests that still wait. A call
    that takes more than ``limit`` seconds counts as failed; its thread can't be stopped, so it is left behind and its place given to the next
    request. ``call`` must be safe to use from several threads where ``width`` is over 1; with neither width nor limit it runs in the caller's.
    """
    asked = list(requests)
    replies: list[Reply | None] = [None] * len(asked)
    waiting, running, came = deque((i, 0) for i in range(len(asked))), {}, queue.SimpleQueue()
    first: dict[int, float] = {}
    tickets = 0

    def run(ticket: int, request: tuple) -> None:
        try:
            came.put((ticket, call(*request), None))
        except Exception as failure:
            came.put((ticket, None, _error(failure)))

    def finish(ticket: int, value: object, error: str | None) -> None:
        index, attempt, _ = running.pop(ticket)
        if error is not None and attempt < retries:
            waiting.append((index, attempt + 1))
        else:
            replies[index] = Reply(value, error, time.monotonic() - first[index])

    while waiting or running:
        while waiting and len(running) < max(1, width):
            index, attempt = waiting.popleft()
            tickets += 1
            running[tickets] = (index, attempt, time.monotonic())
            first.setdefault(index, running[tickets][2])
            if width <= 1 and limit is None:
                run(tickets, asked[index])
            else:
                Thread(target=run, args=(tickets, asked[index]), daemon=True).start()
        due = None if limit is None else max(0.0, min(began for _, _, began in running.values()) + limit - time.monotonic())
        try:
            ticket, value, error = came.get(timeout=due)
        except queue.Empty:
            now = time.monotonic()
            for late in [t for t, (_, _, began) in running.items() if now - began >= limit]:
                finish(late, None, f"no answer within {limit:g} s")
            continue
        if ticket in running:  # else it came after its time
            finish(ticket, value, error)
    return replies
