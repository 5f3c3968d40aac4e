"""Module files: required versions, replacements and who may import a package."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import SchemaError, version


@dataclass
class Module:
    #: a version (three numbers) or a commit id by path
    require: dict[str, tuple[int, int, int] | str] = field(default_factory=dict)
    replace: dict[str, str] = field(default_factory=dict)
    acls: list[str] = field(default_factory=list)
    public: bool = False

    def resolve(self, path: str) -> str:
        """Where an import is read from."""
        return self.replace.get(path, path)

    def allows(self, importer: str) -> bool:
        """Whether ``importer`` may import this package: listed, below a listed ``path/*``, or anyone if public."""
        return self.public or any(importer == a or a.endswith("/*") and importer.startswith(a[:-1]) for a in self.acls)


def parse_module(text: str) -> Module:
    """A module file: ``module``, ``require (``, ``replace (``, ``acls (`` blocks, or ``acls = public``."""
    out, block = Module(), ""
    for number, raw in enumerate(text.split("\n"), 1):
        words = raw.split("//")[0].split() if not raw.strip().startswith("//") else []
        if not words:
            continue
        where = f"line {number}"
        if block:
            if words == [")"]:
                if not getattr(out, block):
                    raise SchemaError(f"{where}: {block} is empty")
                block = ""
            elif block == "require" and len(words) == 2:
                if words[0] in out.require:
                    raise SchemaError(f"{where}: {words[0]} is required twice")
                # what does not hold a version is a commit id
                out.require[words[0]] = version(words[1]) if re.search(r"v\d+\.\d+\.\d+", words[1]) else words[1]
            elif block == "replace" and len(words) == 3 and words[1] == "=>":
                if words[0] in out.replace:
                    raise SchemaError(f"{where}: {words[0]} is replaced twice")
                out.replace[words[0]] = words[2]
            elif block == "acls" and len(words) == 1 and "*" not in words[0].removesuffix("/*"):
                out.acls.append(words[0])
            else:
                raise SchemaError(f"{where}: bad {block} entry {raw.strip()!r}")
        elif words[0] in ("require", "replace", "acls") and words[1:] == ["("]:
            block = words[0]
        elif words == ["acls", "=", "public"]:
            out.public = True
        elif words[0] != "module" or len(words) != 2:
            raise SchemaError(f"{where}: {raw.strip()!r} is not expected here")
    if block:
        raise SchemaError(f"{block} is not closed")
    return out


def not_imported(required: DataFrame, imports: DataFrame, path: str = "path") -> DataFrame:
    """Required modules that nothing imports: a version pin without use is an error."""
    return required.join(imports.select(path).distinct(), path, "left_anti")


def version_column(text: str):
    """A version ``vX.Y.Z`` as a sortable struct of ints, null if it is none."""
    m = F.regexp_extract_all(text, F.lit(r"^v(\d+)\.(\d+)\.(\d+)$"), F.lit(0))
    part = F.transform(F.split(F.substring(text, 2, 1 << 20), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.size(m) > 0, F.struct(F.get(part, 0).alias("major"), F.get(part, 1).alias("minor"), F.get(part, 2).alias("patch")))
