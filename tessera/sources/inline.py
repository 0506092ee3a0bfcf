"""Inline reports: contexts, units and facts of XML documents, one document a row.

A document that is not well formed is read as HTML: elements left open are closed
where their parent ends, and what cannot be read is passed over.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from decimal import Decimal
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.units import number_words

SCHEMA = "document_id string, fact_order int, name string, context_ref string, entity string, start string, end string, unit string, members string, format string, scale int, sign string, display string, value string, error string"
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_MOST_CHARS = 64_000_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ET.Element, parts: dict[str, ET.Element]) -> tuple[str, str | None]:
    """The text of a fact and its continuations; a chain that comes back to itself, or leads nowhere, is an error."""
    out, seen = "".join(node.itertext()), set()
    at = node.get("continuedAt")
    while at:
        if at in seen:
            return out, "continuation_cycle"
        seen.add(at)
        if at not in parts:
            return out, "continuation_missing"
        out += "".join(parts[at].itertext())
        at = parts[at].get("continuedAt")
    return out, None


def number_of(display: str, form: str | None, scale: int | None, sign: str | None) -> str | None:
    """The number of an inline fact as plain digits: by its format (comma or point decimals, fixed zero, number words), a dash as zero, sign and scale; None where it is none."""
    kind = (form or "").lower().rsplit(":", 1)[-1]
    text = re.sub(r"[$€£¥\s]", " ", display).strip()
    negative = (sign == "-") != (text.startswith("(") and text.endswith(")"))
    text = text.strip("() ")
    if "zero" in kind or "nocontent" in kind or text in ("-", "–", "—"):
        value = Decimal(0)
    elif "word" in kind or re.fullmatch(r"[A-Za-z\- ]+", text):
        said = spoken(re.findall(r"[a-z]+", text.lower()))
        if said is None:
            return None
        value = Decimal(said)
    else:
        plain = text.replace(" ", "")
        plain = plain.replace(".", "").replace(",", ".") if "comma" in kind else plain.replace(",", "")
        if not re.fullmatch(r"[0-9]*\.?[0-9]+|[0-9]+\.", plain):
            return None
        value = Decimal(plain)
    value = value.scaleb(scale or 0)
    return format(-value if negative and value else value, "f")


#: the larger number words and their size
_LARGE = {"thousand": 1000, "million": 10**6, "billion": 10**9}


def spoken(words: list[str]) -> int | None:
    """English number words ("one hundred and two thousand five") as a number; "no" and "none" are zero."""
    if words in (["no"], ["none"], ["nil"]):
        return 0
    total, group = 0, []
    for w in words:
        if w == "and":
            continue
        if w in _LARGE:
            below = number_words(group)
            if below is None:
                return None
            total, group = total + below * _LARGE[w], []
        else:
            group.append(w)
    if not group:
        return total if words else None
    below = number_words(group)
    return None if below is None else total + below


class _Recovering(HTMLParser):
    """Builds a tree of whatever markup there is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = ET.SubElement(self.open[-1], tag.rsplit(":", 1)[-1], {_ATTRIBUTES.get(k, k): v or "" for k, v in attrs})
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        ET.SubElement(self.open[-1], tag.rsplit(":", 1)[-1], {_ATTRIBUTES.get(k, k): v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        name = tag.rsplit(":", 1)[-1]
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == name:
                del self.open[i:]
                break

    def handle_data(self, data):
        here = self.open[-1]
        if len(here):
            here[-1].tail = (here[-1].tail or "") + data
        else:
            here.text = (here.text or "") + data


# Element and attribute names that the lower-case reading of HTML has to be given back.
_ATTRIBUTES = {"contextref": "contextRef", "unitref": "unitRef", "continuedat": "continuedAt"}
_ELEMENTS = {"nonfraction": "nonFraction", "nonnumeric": "nonNumeric", "startdate": "startDate", "enddate": "endDate", "explicitmember": "explicitMember"}


def _tree(xml: str) -> ET.Element | None:
    """The tree of a document, recovered where it is not well formed; None where it holds no element."""
    try:
        # A document type with entities of its own is never expanded.
        if "<!ENTITY" not in xml:
            return ET.fromstring(xml)
    except ET.ParseError:
        pass
    parser = _Recovering()
    parser.feed(re.sub(r"<!(?:DOCTYPE|ENTITY)[^>]*>", "", xml))
    parser.close()
    return parser.root if len(parser.root) else None


def _kind(node: ET.Element) -> str:
    name = _local(node.tag) if isinstance(node.tag, str) else ""
    return _ELEMENTS.get(name, name)


def facts_of(document_id: str, xml: str) -> list[tuple]:
    """The facts of a document in order; facts within facts are facts of their own, whose text the outer one holds too."""
    empty = (None,) * (len(_NAMES) - 3)
    root = _tree(xml) if len(xml) <= _MOST_CHARS else None
    if root is None:
        return [(document_id, 0, *empty, "not_parsed")]
    contexts, units, parts, facts = {}, {}, {}, []
    for node in root.iter():
        kind = _kind(node)
        if kind == "context":
            found = {_kind(n): (n.text or "").strip() for n in node.iter()}
            members = sorted(f"{n.get('dimension')}={(n.text or '').strip()}" for n in node.iter() if _kind(n) == "explicitMember")
            contexts[node.get("id")] = (found.get("identifier"), found.get("startDate"), found.get("endDate") or found.get("instant"), ";".join(members) or None)
        elif kind == "unit":
            measures = [(n.text or "").strip() for n in node.iter() if _kind(n) == "measure"]
            units[node.get("id")] = ("/" if any(_kind(n) == "divide" for n in node.iter()) else "*").join(measures)
        elif kind == "continuation":
            parts[node.get("id")] = node
        elif kind in ("nonFraction", "nonNumeric"):
            facts.append(node)
    out = []
    for i, node in enumerate(facts):
        text, error = _text(node, parts)
        context = contexts.get(node.get("contextRef"))
        entity, start, end, members = context or (None,) * 4
        given = node.get("scale")
        scale = int(given) if given and re.fullmatch(r"-?[0-9]{1,3}", given) else None
        shown = " ".join(text.split())
        value = number_of(shown, node.get("format"), scale, node.get("sign")) if _kind(node) == "nonFraction" else None
        out.append((document_id, i, node.get("name"), node.get("contextRef"), entity, start, end, units.get(node.get("unitRef")), members, node.get("format"), scale, node.get("sign"), shown, value, error or (None if context else "no_context")))
    return out


def inline_facts(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """A row for each fact; a document that cannot be parsed gives one row with the error. Null documents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if c in ("fact_order", "scale") else pa.string() for c in _NAMES]
        for b in batches:
            rows = [r for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in facts_of(k, x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)

    return documents.where(F.col(xml).isNotNull()).select(F.col(key).cast("string"), xml).mapInArrow(run, SCHEMA)
