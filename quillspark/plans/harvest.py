"""A whole run over landed inputs: keys, metadata, citations, sources, ledger and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citations as refs
from ..operators import ledger
from ..operators.metadata import fold_metadata, metadata_documents
from ..operators.versions import MAX_VERSIONS
from ..sources import archives as arch


@dataclass(frozen=True)
class Inputs:
    """ids: base_id. versions: PAPER_VERSIONS. citations: CITATIONS. archives: base_id, version, path, length, content."""

    ids: DataFrame
    versions: DataFrame
    citations: DataFrame
    archives: DataFrame


@dataclass(frozen=True)
class Outputs:
    metadata: DataFrame
    references: DataFrame
    members: DataFrame
    results: DataFrame

    def documents(self) -> tuple[DataFrame, DataFrame]:
        return metadata_documents(self.metadata), refs.reference_documents(self.references)


def harvest(inputs: Inputs, done: DataFrame | None = None, most_versions: int = MAX_VERSIONS, compat_keys: bool = False) -> Outputs:
    """Everything about the papers in `ids` that are not in `done`.

    The keys that are left reduce every input before it is worked on, and versions are read once for both
    metadata and sources."""
    ids = ledger.todo(inputs.ids, done) if done is not None else inputs.ids
    mine = lambda df: df.join(ids.select("base_id"), "base_id", "left_semi")
    versions = mine(inputs.versions)
    metadata = fold_metadata(versions, most_versions)
    references = refs.extract_citations(mine(inputs.citations), compat_keys)
    files = arch.gated(mine(inputs.archives))
    members = arch.archive_members(files.drop("status"))
    sources = arch.unpacked_versions(versions.select("base_id", "version", "probe"), files.select("base_id", "version", "path", "length", "status"), members.select("path", "size"), most_versions)
    results = ledger.assemble(ids, metadata, refs.count_citations(references), sources)
    named = members.join(files.select("path", "base_id", "version"), "path").select("base_id", "version", "name", "size", "content")
    return Outputs(metadata, references, named, results)


def report(results: DataFrame) -> DataFrame:
    """Run statistics out of result rows."""
    blank = results.withColumns({"rss_bytes": F.lit(None).cast("long"), "finished_at": F.lit(None).cast("timestamp")})
    return ledger.run_statistics(blank)
