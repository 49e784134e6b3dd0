"""Model calls as a batch operator: requests in, replies out, checked and retried inside the worker.

Calls have side effects and cost money, so callers write the result before anything reads it twice. With a ledger every
sound reply is kept as it arrives, and a task that runs again, or a whole run, asks only for what is missing.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

#: Further attempts after a failed one, and seconds to wait before each, times its number.
RETRIES, BACKOFF = 2, 3.0


class ModelClient(Protocol):
    """Anything picklable that answers a prompt; ``schema`` names the expected reply."""

    def ask(self, schema: str, prompt: str) -> str: ...


class Ledger:
    """Replies by a hash of schema and prompt, one file each, in a folder or store that all machines reach (any place
    pyarrow can open). A file is written under another name and moved, so it is whole or absent."""

    def __init__(self, root: str):
        self.root = root

    def _place(self, schema: str, prompt: str) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.root)
        name = hashlib.sha256(f"{schema}\0{prompt}".encode()).hexdigest()
        return store, f"{path}/{name[:2]}/{name}"

    def get(self, schema: str, prompt: str) -> str | None:
        store, path = self._place(schema, prompt)
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, schema: str, prompt: str, reply: str) -> None:
        store, path = self._place(schema, prompt)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(reply.encode())
        store.move(part, path)


def ask_model(
    requests: DataFrame, client: ModelClient, keys: list[str], retries: int = RETRIES, backoff: float = BACKOFF, check: Callable[[str, str], str] | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """(keys, reply, json, error, attempts) of every request (keys, schema, prompt).

    ``check(schema, reply)`` returns the reply's JSON or raises ValueError; then the model is asked again, as after a
    lost connection. ``reply`` is the last text that came (null if none did), ``json`` what the check returned (the
    reply without a check), null where every attempt failed, and ``error`` says why the last one did. A reply that
    ``ledger`` already has is checked and taken without asking (0 attempts); sound ones are put there at once.
    """

    def one(schema: str, prompt: str) -> tuple[str | None, str | None, str | None, int]:
        reply = error = None
        if ledger and (kept := ledger.get(schema, prompt)) is not None:
            try:
                return kept, check(schema, kept) if check else kept, None, 0
            except ValueError:
                pass  # kept under another check
        for attempt in range(1, retries + 2):
            try:
                reply = client.ask(schema, prompt)
                found = check(schema, reply) if check else reply
                if ledger:
                    ledger.put(schema, prompt, reply)
                return reply, found, None, attempt
            except (TimeoutError, ConnectionError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                if attempt <= retries:
                    time.sleep(backoff * attempt)
        return reply, None, error, retries + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [one(s, p) for s, p in zip(pdf["schema"], pdf["prompt"], strict=True)]
            yield pdf[keys].assign(**{n: pd.Series([t[i] for t in told], index=pdf.index, dtype=object) for i, n in enumerate(("reply", "json", "error"))}, attempts=[t[3] for t in told])

    types = dict(requests.dtypes)
    return requests.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", reply string, json string, error string, attempts int")
