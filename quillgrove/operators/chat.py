"""Models behind a chat completions service: a provider for the seam, and a recogniser of page images."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable

from quillgrove.functions.prompts import DIRECT, rendered, system_message
from quillgrove.operators.provider import Provider, RetryableError

LEFT = "x-ratelimit-remaining-requests"
READ = "Write down the text of this page as it stands, in reading order, without remarks. Reply with nothing for an empty page."


def posted(url: str, body: dict, key: str = "", timeout: float = 120.0, opener=urllib.request.urlopen, listeners: list | None = None) -> str:
    """The reply's text. Statuses 429 and 5xx and failures of the transport are RetryableError, others as they come.

    `listeners` are called with the number of calls that the service says are left.
    """
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body | {"stream": False}).encode(), headers)
    try:
        with opener(request, timeout=timeout) as reply:
            left = reply.headers.get(LEFT) or ""
            if left.isdigit():
                for listener in listeners or ():
                    listener(int(left))
            held = json.load(reply)
    except urllib.error.HTTPError as problem:
        if problem.code == 429 or problem.code >= 500:
            raise RetryableError(f"status {problem.code}") from problem
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as problem:
        raise RetryableError(str(problem)) from problem
    choices = held.get("choices") or []
    if not choices:
        raise ValueError("a reply without choices")
    return choices[0]["message"].get("content") or ""


def checked(url: str, model: str) -> None:
    if not url.startswith(("http://", "https://")):
        raise ValueError(f"not the address of a service: {url!r}")
    if not model:
        raise ValueError("a model's name is needed")


def chat(url: str, model: str, key: str = "", first: str = DIRECT, timeout: float = 120.0, opener=urllib.request.urlopen) -> Provider:
    """A provider that asks a chat completions service; `first` begins the system message.

    Its `listeners` hear how many calls are left; complete() adds its limiter to them.
    """
    checked(url, model)
    listeners: list[Callable[[int], None]] = []

    def run(prompt: str) -> str:
        system = system_message(prompt, first)
        messages = [{"role": "system", "content": system}] if system else []
        return posted(url, {"model": model, "messages": [*messages, {"role": "user", "content": rendered(prompt)}]}, key, timeout, opener, listeners)

    run.listeners = listeners
    return run


def recogniser(url: str, model: str, key: str = "", timeout: float = 120.0, opener=urllib.request.urlopen) -> Callable[[bytes], str]:
    """recognise(png) for adapters.recognised(), by a model that reads images."""
    checked(url, model)

    def run(image: bytes) -> str:
        picture = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}
        return posted(url, {"model": model, "messages": [{"role": "user", "content": [{"type": "text", "text": READ}, picture]}]}, key, timeout, opener)

    return run
