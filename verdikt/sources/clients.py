"""Network clients behind the reader interface: one-token completions, batched generation with exact token ids, chat that
answers in JSON, and joint-schema endpoints. A client lives in a partition's task and keeps its connections.

Only the wire formats are fixed by the servers; readouts are the same rows for all of them.
"""

from __future__ import annotations

import json
import math
import re
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPConnection, HTTPException, HTTPSConnection
from urllib.parse import urlsplit

from .readers import register

#: The least probability whose logarithm is taken; patterns of a named answer and of a letter that stands alone.
LEAST = 1e-12
NAMED, ALONE = re.compile(r'"answer"\s*:\s*"\s*([A-J])'), re.compile(r"\b([A-J])\b")


def best_letters(candidates: Iterable[tuple[str | None, float]], letters: list[str]) -> dict[str, float]:
    """Each letter's greatest log-probability among the tokens that are that letter without white space."""
    out: dict[str, float] = {}
    for token, logp in candidates:
        name = (token or "").strip()
        if name in letters and logp > out.get(name, -math.inf):
            out[name] = logp
    return out


class JsonClient:
    """Posts JSON and times it, up to ``workers`` requests at a time, each thread on a connection that it keeps. Errors are
    raised: the caller tries again and writes error rows."""

    def __init__(self, url: str, letters: list[str], timeout: float = 300.0, workers: int = 1) -> None:
        self.url, self.letters, self.timeout, self.workers = urlsplit(url.rstrip("/")), list(letters), timeout, workers
        self.held = threading.local()
        self.pool: ThreadPoolExecutor | None = None

    def post(self, path: str, body: dict) -> tuple[dict | list, float]:
        began = time.perf_counter()
        for fresh in (False, True):
            kept = getattr(self.held, "connection", None)
            if kept is None:
                kind = HTTPSConnection if self.url.scheme == "https" else HTTPConnection
                kept, fresh = kind(self.url.hostname, self.url.port, timeout=self.timeout), True
                self.held.connection = kept
            try:
                kept.request("POST", self.url.path + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
                answer = kept.getresponse()
                raw = answer.read()
                break
            except (OSError, HTTPException):
                kept.close()
                self.held.connection = None
                if fresh:  # a kept connection may have been closed by the server, a new one not
                    raise
        if answer.status != 200:
            raise RuntimeError(f"{path}: status {answer.status}: {raw[:200].decode(errors='replace')}")
        return json.loads(raw), (time.perf_counter() - began) * 1000

    def each(self, one: Callable, prompts: list) -> list:
        """``one(row_id, prompt)`` of each prompt, in order."""
        if self.workers < 2 or len(prompts) < 2:
            return [one(*p) for p in prompts]
        self.pool = self.pool or ThreadPoolExecutor(self.workers)
        return list(self.pool.map(lambda p: one(*p), prompts))


def details(pairs: list[tuple[str | None, float]], found: dict[str, float], tokens: int | None = None, cached: int | None = None, said: str | None = None, end: str | None = None, most: int = 8) -> dict:
    """What a readout holds besides its letters: the letters' probability mass, the likeliest token, the likeliest ``most``
    tokens, prompt and cached tokens, and an answer's text and reason to end."""
    top = sorted((x for x in pairs if x[0] is not None), key=lambda x: -x[1])[:most]
    return {"option_mass": sum(math.exp(v) for v in found.values()), "first_token": top[0][0] if top else None, "top_tokens": [t for t, _ in top], "prompt_tokens": tokens, "cached_tokens": cached, "content": said, "finish_reason": end}


class CompletionReader(JsonClient):
    """One token of ``/completion`` for each prompt; letters are found among the ``top`` likeliest tokens."""

    def __init__(self, url: str, letters: list[str], top: int = 64, timeout: float = 300.0, workers: int = 8) -> None:
        super().__init__(url, letters, timeout, workers)
        self.top = top

    def read(self, prompts):
        return self.each(self.one, prompts)

    def one(self, row_id, prompt):
        got, ms = self.post("/completion", {"prompt": prompt, "n_predict": 1, "temperature": 0, "n_probs": self.top, "cache_prompt": True, "samplers": []})
        first = (got.get("completion_probabilities") or [{}])[0]
        listed = next((first[k] for k in ("top_logprobs", "top_probs", "probs") if first.get(k)), [])
        pairs = [(c.get("token") or c.get("tok_str"), c["logprob"] if c.get("logprob") is not None else math.log(max(c.get("prob", 0.0), LEAST))) for c in listed]
        found = best_letters(pairs, self.letters)
        return row_id, found, ms, None, details(pairs, found, got.get("tokens_evaluated"), got.get("tokens_cached"), got.get("content"))


class GenerateReader(JsonClient):
    """One token of ``/generate`` for all prompts of a batch in one request. With ``token_ids`` (by letter) the exact ids are
    read instead of the likeliest tokens; prompts may be lists of ids."""

    def __init__(self, url: str, letters: list[str], top: int = 64, token_ids: dict[str, int] | None = None, beside: int = 8, timeout: float = 600.0) -> None:
        super().__init__(url, letters, timeout)
        self.top, self.token_ids, self.beside = top, token_ids, beside

    def read(self, prompts):
        kind = "text" if not prompts or isinstance(prompts[0][1], str) else "input_ids"
        body = {kind: [p if kind == "text" else list(p) for _, p in prompts], "sampling_params": {"max_new_tokens": 1, "temperature": 0}, "return_logprob": True, "logprob_start_len": -1, "return_text_in_logprobs": True, "top_logprobs_num": self.beside if self.token_ids else self.top}
        if self.token_ids:
            body["token_ids_logprob"] = [[self.token_ids[x] for x in self.letters]] * len(prompts)
        got, ms = self.post("/generate", body)
        out = []
        for (row_id, _), one in zip(prompts, got, strict=True):
            meta = one.get("meta_info", {})
            pairs = [(x[2] if len(x) > 2 else None, x[0]) for x in (meta.get("output_top_logprobs") or [[]])[0]]
            found = self._exact(meta) if self.token_ids else best_letters(pairs, self.letters)
            out.append((row_id, found, ms / len(prompts), None, details(pairs, found, meta.get("prompt_tokens"), meta.get("cached_tokens"), one.get("text"))))
        return out

    def _exact(self, meta: dict) -> dict[str, float]:
        exact = {int(x[1]): x[0] for x in (meta.get("output_token_ids_logprobs") or [[]])[0]}
        return {x: exact[self.token_ids[x]] for x in self.letters if self.token_ids[x] in exact}


class ChatReader(JsonClient):
    """A short answer of ``/v1/chat/completions``. A prompt is a user's text, or the JSON text of a list of messages. The letter
    that the answer names has all the probability; an answer without one has no letters."""

    def __init__(self, url: str, letters: list[str], timeout: float = 300.0, workers: int = 8, answer_tokens: int = 48) -> None:
        super().__init__(url, letters, timeout, workers)
        self.answer_tokens = answer_tokens

    def read(self, prompts):
        return self.each(self.one, prompts)

    def one(self, row_id, prompt):
        messages = json.loads(prompt) if prompt.startswith("[{") else [{"role": "user", "content": prompt}]
        got, ms = self.post("/v1/chat/completions", {"messages": messages, "max_tokens": self.answer_tokens, "temperature": 0, "cache_prompt": True})
        choice, usage = got["choices"][0], got.get("usage") or {}
        said = choice["message"].get("content") or ""
        letter = next((m.group(1) for m in (NAMED.search(said), ALONE.search(said)) if m and m.group(1) in self.letters), None)
        found = {letter: 0.0} if letter else {}
        cached = (usage.get("prompt_tokens_details") or {}).get("cached_tokens")
        return row_id, found, ms, None, details([], found, usage.get("prompt_tokens"), cached, said, choice.get("finish_reason"))


def option_ids(question: dict) -> list[str]:
    """The ids under which a joint-schema endpoint answers a question: true and false, the places of a scale's criteria, or the
    names of the options."""
    if question["type"] == "noul":
        return ["true", "false"]
    asked = question.get("criteria") or question.get("options") or {}
    return [str(i) for i in range(len(asked))] if isinstance(asked, list) else list(asked)


class SchemaReader(JsonClient):
    """A joint-schema endpoint: a prompt is the JSON text of state, question and, if ids aren't to be read in the question's order,
    ``letters`` (a letter by option id). Probabilities are taken by option id, whatever their order in the answer, or from
    the one number of a yes-or-no question. An option that the answer lacks is an error."""

    def __init__(self, url: str, letters: list[str], model: str = "default", path: str = "/v1/answers", timeout: float = 600.0, workers: int = 8) -> None:
        super().__init__(url, letters, timeout, workers)
        self.model, self.path = model, path

    def read(self, prompts):
        return self.each(self.one, prompts)

    def one(self, row_id, prompt):
        asked = json.loads(prompt)
        question, ids = asked["question"], option_ids(asked["question"])
        letter = asked.get("letters") or dict(zip(ids, self.letters, strict=False))
        if not ids or len(ids) > len(letter):
            raise ValueError(f"{len(ids)} options for {len(letter)} letters")
        got, ms = self.post(self.path, {"model": self.model, "state": asked["state"], "questions": {"q": question}})
        answer = got["answers"]["q"]
        p = answer.get("probabilities") or {}
        if question["type"] == "noul" and "noul" in answer:
            p = {"true": float(answer["noul"]), "false": 1.0 - float(answer["noul"])}
        if gone := [i for i in ids if i not in p]:
            raise ValueError(f"no probability for the options {gone}")
        found = {letter[i]: math.log(max(float(p[i]), LEAST)) for i in ids}
        return row_id, found, ms, None, details([], found)


def budget_batches(lengths: list[int], budget: int, most: int = 32) -> list[list[int]]:
    """Numbers of the rows of each batch: rows sorted by length, as many as fit the budget when all are padded to the longest."""
    order, out = sorted(range(len(lengths)), key=lambda i: lengths[i]), []
    for i in order:
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


for _name, _client in {"completion": CompletionReader, "generate": GenerateReader, "chat": ChatReader, "schema": SchemaReader}.items():
    register(_name, _client)
