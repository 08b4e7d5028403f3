"""Generators: prompts to answers, and what may go wrong on the way."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.errors import GenerationError

#: (class, pattern in the lower-cased message, what the user is told), first match wins.
CLASSES = (
    ("bad_key", r"api key|401|403", "The API key was rejected. Check it and try again."),
    ("rate_limit", r"429|quota|(^|[^a-z])rate([^a-z]|$)", "The service's limit of requests is reached. Try again later."),
)
CLIENT, SERVER, OTHER = "The service refused the request.", "The service is not available. Try again later.", "The answer could not be generated."


def error_class(message: Column, kind: Column | None = None) -> Column:
    """bad_key, rate_limit, or the kind of failure: client, server or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("client") if kind is None else kind
    for name, pattern, _ in reversed(CLASSES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def explain(message: str, kind: str = "client") -> str:
    """What the user is told about a failed call. kind: client, server or other."""
    if kind == "client":
        for _, pattern, text in CLASSES:
            if re.search(pattern, message.lower()):
                return text
    return {"client": CLIENT, "server": SERVER}.get(kind, OTHER)


class Generator(Protocol):
    """`generate` answers one prompt or raises; `column` gives a struct (answer, error) for each of a column of them."""

    def generate(self, prompt: str) -> str: ...

    def column(self, prompt: Column, chunks: Column) -> Column: ...


def answered(batches: Iterator[pd.Series], generate: Callable[[str], str]) -> Iterator[pd.DataFrame]:
    """(answer, error) of prompts: a call that fails costs its own row only."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return generate(prompt), None
        except GenerationError as e:
            return None, str(e)

    for prompts in batches:
        yield pd.DataFrame([one(p) for p in prompts], columns=["answer", "error"])


class Extractive:
    """Answers with the text of the best hit. Needs no model and no network."""

    NOTHING = "The answer is not available in the documents."

    def generate(self, prompt: str) -> str:
        found = re.search(r"\nPassages:\n\[Page [^\n]*\]\n(.*?)\n\n(?:\[Page |Question:\n)", prompt, re.DOTALL)
        return found[1].strip() if found else self.NOTHING

    def column(self, prompt: Column, chunks: Column) -> Column:
        best = F.coalesce(F.try_element_at(chunks, F.lit(1))["text"], F.lit(self.NOTHING))
        return F.struct(best.alias("answer"), F.lit(None).cast("string").alias("error"))


def api_key(variable: str = "GEMINI_API_KEY") -> str:
    """The key, from the driver's environment; it never enters a DataFrame."""
    key = os.environ.get(variable, "").strip()
    if not key:
        raise ValueError(f"set {variable} to use this generator")
    return key


class Gemini:
    """A remote model. Calls run on the executors, so answers should be written before they are used again."""

    def __init__(self, model: str = Config.llm_model, key: str | None = None):
        self.model, self.key = model, key or api_key()
        try:
            from google import genai  # noqa: F401
        except ImportError as e:
            raise ImportError("the google-genai package is needed for this generator") from e

    def client(self):
        from google import genai

        return genai.Client(api_key=self.key)

    def generate(self, prompt: str, client=None) -> str:
        from google.genai import errors, types

        try:
            client = client or self.client()
            reply = client.models.generate_content(model=self.model, contents=prompt, config=types.GenerateContentConfig(temperature=Config.temperature))
        except errors.ClientError as e:
            raise GenerationError(explain(str(e))) from e
        except errors.ServerError as e:
            raise GenerationError(explain(str(e), "server")) from e
        except Exception as e:
            raise GenerationError(explain(str(e), "other")) from e
        if not (reply.text or "").strip():
            raise GenerationError("The service gave an empty answer.")
        return reply.text.strip()

    def column(self, prompt: Column, chunks: Column) -> Column:

        own = self

        @F.pandas_udf("answer string, error string")
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            client = own.client()  # one for all batches of a task
            yield from answered(batches, lambda p: own.generate(p, client))

        return answer(prompt)


PROVIDERS = {"gemini": Gemini, "extractive": Extractive}


def create_generator(provider: str = Config.llm_provider, **options) -> Generator:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[provider](**options)
