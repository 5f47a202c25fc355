"""Carrying a plan out, and taking it back. Nothing is ever deleted: `delete` moves to the trash folder.

Files are moved by tasks, each on its own rows; what happened is a table, the manifest, written as it
goes. A task that runs again finds the file already at its target and says so, so lost executors cost
nothing. Without commit nothing is touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import paths
from keepsake.tables import stash

MANIFEST = "path string, action string, target string, sha256 string, status string"
DONE = ("moved", "already there")
TRASH = "trash/transferred"


def targets(planned: DataFrame, destinations: list[str | None], trash: str = "trash") -> DataFrame:
    """planned(path, rule, action) with target, of the rows to act on. Folders aren't kept; of equal names in
    one folder, case aside, the first by path keeps it, the others get ` (2)`, ` (3)`, leaving out the
    numbers that names of the folder have already, so no two rows have one target. destinations: of
    each rule, by its place."""
    where = F.when(F.col("action") == "delete", F.lit(trash)).otherwise(F.get(F.array(*(F.lit(d or "") for d in destinations)), F.col("rule")))
    acting = planned.where(F.col("action").isin("delete", "move", "transfer")).withColumn("_dir", where).withColumn("_name", paths.base(F.col("path")))
    place = F.row_number().over(Window.partitionBy("_dir", F.lower("_name")).orderBy("path")) - 1
    placed = acting.select("path", "action", "_dir", "_name", F.lower("_name").alias("_key"), place.cast("long").alias("_nth"))
    #: the numbers from 2 on of names like `a (7).jpg`, under the name `a.jpg`, in ascending order
    pattern = r"^(.+) \(([1-9]\d{0,8})\)(\.[^.]*)?$"
    numbered = placed.where("_nth = 0").select("_dir", F.concat(F.regexp_extract("_key", pattern, 1), F.regexp_extract("_key", pattern, 3)).alias("_key"), F.regexp_extract("_key", pattern, 2).try_cast("long").alias("_no")).where("_no >= 2")
    again = placed.where("_nth > 0").select("_dir", "_key").distinct()
    order = Window.partitionBy("_dir", "_key")
    # the n-th copy has the n-th free number: n + 1, and one more for each taken number that isn't beyond it
    taken = numbered.join(again, ["_dir", "_key"], "left_semi").select("_dir", "_key", (F.col("_no") - F.row_number().over(order.orderBy("_no"))).alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast("string").alias("path"))
    both = placed.where("_nth > 0").select("_dir", "_key", F.col("_nth").alias("_at"), F.lit(1).alias("_ask"), "path").unionByName(taken)
    passed = F.sum(1 - F.col("_ask")).over(order.orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    numbers = both.withColumn("_no", F.col("_at") + 1 + passed).where("_ask = 1").select("path", "_no")
    ext = F.regexp_extract("_name", r"^.+(\.[^.]*)$", 1)
    bare = F.substring(F.col("_name"), F.lit(1), F.length("_name") - F.length(ext))
    named = F.when(F.col("_no").isNull(), F.col("_name")).otherwise(F.concat(bare, F.lit(" ("), F.col("_no").cast("string"), F.lit(")"), ext))
    return placed.join(numbers, "path", "left").withColumn("target", F.concat_ws("/", "_dir", named)).select("path", "action", "target")


def _moved(rows: DataFrame, root: str) -> DataFrame:
    def run(batches):
        import hashlib

        import pyarrow as pa

        from keepsake.sources.archives import _filesystem

        store, base = _filesystem(root)

        def there(p):
            return store.get_file_info(f"{base}/{p}").type.name == "File"

        def digest(p):
            h = hashlib.sha256()
            with store.open_input_stream(f"{base}/{p}") as f:
                while part := f.read(1 << 20):
                    h.update(part)
            return h.hexdigest()

        for b in batches:
            out = []
            for path, action, target in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                status, sha = "missing", None
                if there(path) and there(target):
                    status = "occupied"
                elif there(target):
                    status, sha = "already there", digest(target)
                elif there(path):
                    sha = digest(path)
                    store.create_dir(f"{base}/{target}".rsplit("/", 1)[0], recursive=True)
                    if action == "transfer":  # copied, compared, and only then moved out of the way
                        store.copy_file(f"{base}/{path}", f"{base}/{target}.part")
                        if digest(f"{target}.part") != sha:
                            out.append((path, action, target, sha, "differs"))
                            continue
                        store.move(f"{base}/{target}.part", f"{base}/{target}")
                        store.create_dir(f"{base}/{TRASH}", recursive=True)
                        store.move(f"{base}/{path}", f"{base}/{TRASH}/{sha}")
                    else:
                        store.move(f"{base}/{path}", f"{base}/{target}")
                    status = "moved"
                out.append((path, action, target, sha, status))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5, names=["path", "action", "target", "sha256", "status"])

    return rows.mapInArrow(run, MANIFEST)


def execute(acting: DataFrame, root: str, commit: bool = False) -> DataFrame:
    """The manifest of acting(path, action, target), paths below root. Dry without commit."""
    if not commit:
        return acting.select("path", "action", "target", F.lit(None).cast("string").alias("sha256"), F.lit("planned").alias("status"))
    return stash(_moved(acting, root), "manifest")


def undo(manifest: DataFrame, root: str, commit: bool = False) -> DataFrame:
    """Moves what the manifest says was moved back to where it was; what is gone or in the way stays."""
    back = manifest.where(F.col("status").isin(*DONE)).select(F.col("target").alias("path"), F.lit("undo").alias("action"), F.col("path").alias("target"))
    return execute(back, root, commit)
