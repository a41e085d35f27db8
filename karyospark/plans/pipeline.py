"""The whole workflow: reads to ratio, calls to sites, ratio to segments, and inference, with stages kept as Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.coverage import normalized
from ..operators.segmentation import segment
from ..operators.snp import het_snps, with_log_odds
from ..params import Params
from ..session import remove
from ..sources import sinks
from .infer import Inference, infer

#: The steps by their numbers; preparing is making folders here, and site calling is an external program's.
STEPS = ("prepare", "het_snps", "normalize", "segment", "infer", "report")


#: The tables of each stage.
TABLES = {"het_snps": ("het_snps",), "normalize": ("normalize", "normalize_stats"), "segment": ("segment",)}
#: The parameters that a stage's rows depend on, beside those of the stages before it.
DEPENDS = {
    "het_snps": ("snp_min_depth", "snp_max_depth"),
    "normalize": ("window_size", "max_fragment", "min_mapq", "max_coverage", "smooth_half", "ratio_scale"),
    "segment": ("segment_min_length", "segment_threshold", "segment_a", "segment_b", "segment_tolerance", "segment_rounds", "segment_max_alpha", "trim_percent"),
}


def file_marks(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files that the paths or patterns name; of folders, of the files in them."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.globStatus(at) or []:
            for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


@dataclass
class Workflow:
    """Runs the steps in order. Each is written to the folder, from where a later run can go on with any step.

    A ledger keeps what each stage was made of: its parameters, the marks of its input files (sources: paths by stage)
    and the stages before it. A stage before the first step wanted is taken as it is only where that is unchanged; a stale or
    unfinished one is made anew, and so is what follows it. Inputs without sources count as unchanged.
    """

    spark: SparkSession
    folder: str
    params: Params = Params()
    sources: dict[str, list[str]] = field(default_factory=dict)
    #: The stages that the last run made, not took.
    made: list[str] = field(default_factory=list)

    def mark(self, name: str, before: tuple[str, ...] = ()) -> str:
        """A digest of what the stage is made of."""
        params = asdict(self.params)
        about = [name, {k: params[k] for k in DEPENDS[name]}, file_marks(self.spark, self.sources.get(name, [])), before]
        return hashlib.sha256(json.dumps(about).encode()).hexdigest()

    def finished(self, name: str) -> str | None:
        """The mark of the stage that lies in the folder whole, None without one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger/{name}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.text(f"{self.folder}/ledger/{name}").first()["value"]

    def step(self, name: str, start_from: str, mark: str, make: Callable[[], tuple[DataFrame, ...]]) -> list[DataFrame]:
        """The tables of a stage; the ledger's entry goes before they are written and comes after."""
        tables = TABLES[name]
        if STEPS.index(name) >= STEPS.index(start_from) or self.finished(name) != mark:
            remove(self.spark, f"{self.folder}/ledger/{name}")
            for table, rows in zip(tables, make(), strict=True):
                rows.write.mode("overwrite").parquet(f"{self.folder}/{table}")
            self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{self.folder}/ledger/{name}")
            self.made.append(name)
        return [self.spark.read.parquet(f"{self.folder}/{t}") for t in tables]

    def run(self, reads: DataFrame, calls: DataFrame, contigs: DataFrame, start_from: str = STEPS[0], strict: bool = False, auto: bool = True, debug: bool = False, report: bool = False) -> Inference:
        """report: writes the text outputs beside the stages."""
        p = self.params
        self.made = []
        (snps,) = self.step("het_snps", start_from, self.mark("het_snps"), lambda: (het_snps(calls, p),))
        normal = self.mark("normalize")
        ratio, stats = self.step("normalize", start_from, normal, lambda: normalized(reads, contigs, p))
        (segments,) = self.step("segment", "segment" if "normalize" in self.made else start_from, self.mark("segment", (normal,)), lambda: (segment(ratio, p),))
        got = infer(segments, with_log_odds(snps), contigs, p, strict, auto)
        if report:
            out = f"{self.folder}/{STEPS[-1]}"
            sinks.write_het_snps(snps, f"{out}/het_snp.tsv")
            sinks.write_ratio(ratio, f"{out}/ratio", debug, stats, p.window_size)
            sinks.write_segments(segments, f"{out}/all_segments.tsv")
            sinks.write_inference(got, f"{out}/infer")
        return got
