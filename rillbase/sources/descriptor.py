"""Descriptors: the declared schema of a flat file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\b": "\b", "\\f": "\f", "\\r": "\r", "\\\\": "\\"}


@dataclass(frozen=True)
class Attribute:
    """An attribute ends at ``delimiter`` or has ``width`` bytes; ``justify`` l, r or c and ``print_width`` are for reports."""

    name: str
    delimiter: str | None = ":"
    width: int | None = None
    justify: str = "l"
    print_width: int = 12
    label: str = ""
    hidden: bool = False

    def field(self) -> T.StructField:
        meta = {"delimiter": self.delimiter, "width": self.width, "justify": self.justify, "print_width": self.print_width, "label": self.label, "hidden": self.hidden}
        return T.StructField(self.name, T.StringType(), True, {k: v for k, v in meta.items() if v is not None})


@dataclass(frozen=True)
class Descriptor:
    attributes: tuple[Attribute, ...]

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def schema(self) -> T.StructType:
        return T.StructType([a.field() for a in self.attributes])

    def shown(self) -> list[str]:
        return [a.name for a in self.attributes if not a.hidden]

    @classmethod
    def of(cls, schema: T.StructType) -> Descriptor:
        """The descriptor of a DataFrame's schema; what its metadata doesn't say has the usual value. The last attribute ends its line."""
        out = []
        for i, f in enumerate(schema):
            m = f.metadata or {}
            delimiter = "\n" if i == len(schema) - 1 else m.get("delimiter", None if m.get("width") else ":")
            out.append(Attribute(f.name, delimiter if delimiter != "\n" or i == len(schema) - 1 else ":", None if delimiter == "\n" else m.get("width"), m.get("justify", "l"), m.get("print_width", 12), m.get("label", ""), m.get("hidden", False)))
        return cls(tuple(out))


def read_descriptor(text: str) -> Descriptor:
    """Lines of ``name<TAB>t<delimiter>|w<width>[<TAB>l|r|c<width>[<TAB>label]]``. A capital letter or width 0 hides an attribute."""
    out = []
    lines = [x for x in text.split("\n") if x.strip() and not x.startswith(("#", "%description", "%enddescription"))]
    for line in lines:
        name, *parts = line.split("\t")
        kind = parts[0] if parts and parts[0] else "t:"
        justify = parts[1] if len(parts) > 1 and parts[1] else "l12"
        label = parts[2] if len(parts) > 2 else ""
        delimiter, width = None, None
        if kind[0] == "w":
            width = int(kind[1:])
        else:
            raw = kind[1:]
            delimiter = _ESCAPES.get(raw, raw) or "\t"
            if kind == "t" and len(parts) > 0 and line.split("\t")[1] == "t":
                delimiter = "\t"
                justify = parts[2] if len(parts) > 2 and parts[2] else "l12"
                label = parts[3] if len(parts) > 3 else ""
        size = int(justify[1:] or 12)
        out.append(Attribute(name, delimiter, width, justify[0].lower(), size, label, justify[0].isupper() or size == 0))
    if out and out[-1].width is None and out[-1].delimiter != "\n":
        raise ValueError("the last attribute must end in a newline")
    return Descriptor(tuple(out))


def write_descriptor(d: Descriptor) -> str:
    back = {v: k for k, v in _ESCAPES.items()}
    lines = []
    for a in d.attributes:
        kind = f"w{a.width}" if a.width is not None else "t" + back.get(a.delimiter, a.delimiter)
        letter = a.justify.upper() if a.hidden and a.print_width else a.justify
        lines.append(f"{a.name}\t{kind}\t{letter}{a.print_width}" + (f"\t{a.label}" if a.label else ""))
    return "\n".join(lines) + "\n"


def split_inline(text: str) -> tuple[Descriptor | None, str]:
    """The descriptor between ``%description`` and ``%enddescription`` at the head of a text, and what follows."""
    if not text.startswith("%description"):
        return None, text
    head, _, rest = text.partition("%enddescription")
    return read_descriptor(head.split("\n", 1)[1]), rest.split("\n", 1)[1] if "\n" in rest else ""
