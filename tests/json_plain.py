"""Plain versions of the JSON walks, for comparison."""

import json
import re


def loads(text):
    """The value of a JSON text, trailing commas forgiven; None if there is none."""
    if text is None:
        return None
    for t in (text.strip(), re.sub(r",\s*([}\]])", r"\1", text.strip())):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def objects(value):
    """All objects of a value, each before those inside it."""
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return ([value] if isinstance(value, dict) else []) + [o for v in inner for o in objects(v)]


def lists(value):
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return ([value] if isinstance(value, list) else []) + [x for v in inner for x in lists(v)]


def record_list(value, least=3):
    """The objects of the list that holds most of them, the first on a tie."""
    held = [[x for x in one if isinstance(x, dict)] for one in lists(value)]
    best = max(held, key=len, default=[])
    return best if len(best) >= least else []


def plain_paths(value, levels=3, before=()):
    """Dotted paths of the values that are neither objects nor lists, at most `levels` keys deep, and whether they are booleans."""
    out = []
    for k, v in value.items():
        if isinstance(v, dict):
            out += plain_paths(v, levels - 1, (*before, k)) if levels > 1 else []
        elif not isinstance(v, list):
            out.append((".".join((*before, k)), isinstance(v, bool)))
    return out
