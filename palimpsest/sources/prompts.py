"""Prompts in layers: a template, read from a file or given, that renders to chat messages."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from palimpsest.functions.constants import ACKNOWLEDGED, LAYERS
from palimpsest.functions.reply import PLACE, heading


@dataclass(frozen=True)
class Template:
    """Named layers in the order in which they are said, none of them blank."""

    layers: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, given: object, where: str = "the template") -> Template:
        """The layers of a mapping; of a list of mappings, those of all, of which the later stand for a name."""
        named: dict[str, str] = {}
        for part in given if isinstance(given, list) else [given]:
            if not isinstance(part, Mapping):
                raise ValueError(f"{where} is no mapping of layers")
            named |= {str(k): v if isinstance(v, str) else "" for k, v in part.items()}
        own = tuple((name, named[name]) for name in LAYERS if not named.get(name, "").isspace() and named.get(name))
        if not own:
            raise ValueError(f"{where} has none of the layers {', '.join(LAYERS)}")
        return cls(own)

    @classmethod
    def read(cls, path: str) -> Template:
        """From a file: JSON, or YAML where the yaml package is installed."""
        file = Path(path)
        if file.suffix == ".json":
            return cls.of(json.loads(file.read_text(encoding="utf-8")), path)
        try:
            from yaml import safe_load
        except ImportError as error:
            raise ValueError(f"{path}: only JSON is read without the yaml package") from error
        return cls.of(safe_load(file.read_bytes()), path)

    def needs(self) -> set[str]:
        """What its {places} ask for."""
        return {name for _, body in self.layers for name in PLACE.findall(body)}

    def render(self, inputs: Mapping[str, str]) -> list[dict[str, str]]:
        """The chat: a turn for each layer, its places filled in once, and what is answered to it before the next."""
        if lacking := sorted(self.needs() - inputs.keys()):
            raise KeyError(f"missing inputs: {lacking}")
        filled = [(name, PLACE.sub(lambda m: inputs[m[1]], body)) for name, body in self.layers]
        turns = [("user", heading(i, len(filled)) + body, name) for i, (name, body) in enumerate(filled, 1)]
        said = [x for role, body, name in turns for x in ((role, body), ("assistant", ACKNOWLEDGED.get(name)))][:-1]
        return [{"role": role, "content": body} for role, body in said if body is not None]


#: A short template of our own, used where none is given.
DEFAULT = Template.of({
    "schema_contract": 'Answer with one JSON object: {"entities": [{"text": "...", "category": "...", "aliases": ["..."]}]}. Nothing before it, nothing after it.',
    "business_rules": "List every value that identifies a person, an organisation or an account, as it is written. Categories: {categories}. Leave out common words.",
    "task": "Text:\n{text}",
})
