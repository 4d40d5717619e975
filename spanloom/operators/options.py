"""A key for nested options."""

from __future__ import annotations

import json
from collections.abc import Mapping


def option_key(value: object) -> str:
    """A text that is equal for equal nested options, whatever the order of their keys."""
    def plain(x):
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, set | frozenset):
            return sorted((plain(v) for v in x), key=repr)
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x if isinstance(x, str | int | float | bool | None) else repr(x)

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False)
