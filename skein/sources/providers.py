"""Embedding services over HTTP, as embedders: what is sent and read, retries, and where keys come from."""

from __future__ import annotations

import json
import os
import random
import stat
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from skein.sources.config import DIMENSIONS

#: Attempts, statuses that are tried again, first wait in seconds, and the most texts of a request by service.
ATTEMPTS, AGAIN, FIRST_WAIT = 4, (429, 502, 503, 504), 0.2
MOST_TEXTS = {"voyage": 128}
#: Addresses of the services.
ADDRESSES = {"voyage": "https://api.voyageai.com/v1", "openai": "https://api.openai.com/v1", "ollama": "http://127.0.0.1:11434"}

#: Sends a request (address, headers, body, seconds) and gives status and body.
Send = Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]]


def post(address: str, headers: dict[str, str], body: bytes, seconds: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(address, body, headers), timeout=seconds) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def with_retries(send: Callable[[], tuple[int, bytes]], wait: Callable[[float], None] = time.sleep) -> bytes:
    """The body of the first answer that is no error; transport errors and overload are tried again, each time after a longer wait."""
    for n in range(ATTEMPTS):
        last = n == ATTEMPTS - 1
        try:
            status, body = send()
        except OSError:
            if last:
                raise
        else:
            if 200 <= status < 300:
                return body
            if last or status not in AGAIN:
                raise RuntimeError(f"the service answered {status}: {body.decode(errors='replace')}")
        wait(FIRST_WAIT * 2**n * (1 + random.random() / 4))
    raise AssertionError("unreachable")


def check_key_file(path: str) -> None:
    """A regular file, no link, of this user, that nobody else may read."""
    p = Path(path)
    if p.is_symlink() or not p.is_file():
        raise ValueError(f"no regular file: {path}")
    s = p.stat()
    if stat.S_IMODE(s.st_mode) & 0o077:
        raise ValueError(f"others may read {path}; expected 600")
    if s.st_uid != os.geteuid():
        raise ValueError(f"{path} belongs to another user")


def api_key(variable: str | None, file: str | None) -> str:
    """From the environment first, then from a key file."""
    value = os.environ.get(variable, "").strip() if variable else ""
    if value:
        return value
    if file:
        check_key_file(file)
        value = Path(file).read_text().strip()
        if value:
            return value
        raise ValueError(f"{file} is empty")
    raise ValueError(f"no key: set {variable} or name a key file" if variable else "no source of a key is configured")


@dataclass
class HttpEmbedder:
    """An embedder of one service and model. ``purpose`` is ``document`` or ``query``; only some services tell them apart.

    An instance is sent to the workers with its key.
    """

    service: str
    model: str
    key: str | None = None
    address: str | None = None
    size: int | None = None
    purpose: str = "document"
    send: Send = field(default=post, repr=False)

    @property
    def name(self) -> str:
        return f"{self.service}:{self.model}"

    @property
    def dimension(self) -> int:
        """As configured, as known of the model, or as the service answers."""
        if self.size is None:
            self.size = DIMENSIONS.get(self.model) or len(self.embed(["dimension"])[0])
        return self.size

    def embed(self, texts: list[str]) -> list[list[float]]:
        most = MOST_TEXTS.get(self.service, len(texts) or 1)
        return [v for at in range(0, len(texts), most) for v in self._batch(texts[at : at + most])]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        body: dict[str, object] = {"model": self.model, "input": texts}
        if self.service == "voyage":
            body["input_type"] = self.purpose
        base = (self.address or ADDRESSES[self.service]).rstrip("/")
        address = f"{base}/api/embed" if self.service == "ollama" else f"{base}/embeddings"
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        seconds = 20.0 if len(texts) == 1 else 120.0
        answer = json.loads(with_retries(lambda: self.send(address, headers, json.dumps(body).encode(), seconds)))
        if self.service == "ollama":
            vectors = answer["embeddings"]
        else:
            rows = answer["data"]
            vectors = [r["embedding"] for r in (sorted(rows, key=lambda r: r["index"]) if all("index" in r for r in rows) else rows)]
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
