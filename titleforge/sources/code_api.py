"""Codes from an HTTP service, behind a transport that tests replace; off unless a key is set and the network is allowed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

#: (url, headers) -> (status, body).
Transport = Callable[[str, dict[str, str]], tuple[int, str]]


def dig(value: object, path: str) -> object:
    """What a dotted path leads to in nested objects; None where a step is missing."""
    for name in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


class CodeService:
    def __init__(self, url: str, key: str, transport: Transport, batch: int = 25, per_second: float = 4.0, retries: int = 3, budget: int = 1000, sleep: Callable[[float], None] = time.sleep, patent_field: str = "applicationMetaData.patentNumber", code_field: str = "applicationMetaData.cpcClassificationBag") -> None:
        if not key:
            raise ValueError("no key for the code service")
        self.url, self.key, self.transport = url, key, transport
        self.patent_field, self.code_field = patent_field, code_field
        self.batch, self.pause, self.retries, self.budget, self.sleep = batch, 1 / per_second, retries, budget, sleep

    def _send(self, query: str) -> dict:
        """404 is empty, other 4xx end the run, the rest is tried again after growing pauses."""
        for attempt in range(self.retries + 1):
            if self.budget <= 0:
                raise RuntimeError("the budget of calls is used up")
            self.budget -= 1
            status, body = self.transport(f"{self.url}?q={query}", {"X-API-KEY": self.key})
            if status == 200:
                return json.loads(body)
            if status == 404:
                return {}
            if 400 <= status < 500 and status != 429:
                raise RuntimeError(f"the code service answered {status}")
            self.sleep(2.0**attempt)
        raise RuntimeError("the code service doesn't answer")

    def fetch(self, ids: Iterable[str]) -> dict[str, list[str]]:
        wanted = list(dict.fromkeys(ids))
        found: dict[str, list[str]] = {}
        for at in range(0, len(wanted), self.batch):
            part = wanted[at : at + self.batch]
            for entry in self._send(" OR ".join(part)).get("patentFileWrapperDataBag", []):
                number, listed = dig(entry, self.patent_field), dig(entry, self.code_field)
                codes = [str(c).strip() for c in listed if c and str(c).strip()] if isinstance(listed, list) else []
                if number in part:
                    found[number] = list(dict.fromkeys(codes))
            self.sleep(self.pause)
        return found

    def probe(self, number: str = "10000000") -> str:
        """Asks for one patent; says "ok" or what went wrong."""
        try:
            self._send(number)
        except (RuntimeError, OSError, ValueError) as e:
            return str(e)
        return "ok"
