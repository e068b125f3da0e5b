"""Episode stores in Zarr v3 as a Spark data source.

A store is a folder <id>.zarr with zarr.json (attributes) and one folder an array: zarr.json and chunks c/i/j. Planning lists
folders only and never looks into a store; a task reads a few stores, and of each only the group's metadata and the arrays
asked for, whose chunks follow from their metadata. A store that can't be read gives a row with its error.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Array keys by arm, and keys that are tried where neither arm has one.
ARM_KEYS = {"left": "left.obs_ee_pose", "right": "right.obs_ee_pose"}
FALLBACK_KEYS = ("obs_ee_pose", "ee_pose", "left.obs_wrist_pose", "right.obs_wrist_pose", "obs_head_pose")
POSES = "episode_id string, arm string, frame int, x double, y double, z double, total_frames int, fps double, task_name string, task_description string, embodiment string, error string"
STORES = "path string, episode_id string, source string"
_BATCH = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (c.split() for c in POSES.split(", "))])


def _decode(meta: dict, chunks: dict[str, bytes]) -> np.ndarray:
    shape, grid = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    separator = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    kind = np.dtype(meta["data_type"])
    out = np.full(shape, meta.get("fill_value") or 0, kind)
    for at in np.ndindex(*(math.ceil(s / g) for s, g in zip(shape, grid))):
        raw = chunks.get(separator.join(["c", *map(str, at)]))
        if raw is None:
            continue
        for codec in reversed(meta.get("codecs", [])):
            name = codec["name"]
            if name == "zstd":
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif name == "gzip":
                raw = gzip.decompress(raw)
            elif name == "bytes":
                if codec.get("configuration", {}).get("endian") == "big":
                    kind = kind.newbyteorder(">")
            elif name != "crc32c":
                raise ValueError(f"codec {name} is not supported")
            else:
                raw = raw[:-4]
        block = np.frombuffer(raw, kind).reshape(grid)
        where = tuple(slice(i * g, min((i + 1) * g, s)) for i, g, s in zip(at, grid, shape))
        out[where] = block[tuple(slice(0, w.stop - w.start) for w in where)]
    return out.astype(float)


@dataclass
class Store(InputPartition):
    """A store: its full path, the episode's id and the source, which is the first folder below the root."""

    path: str
    episode_id: str
    source: str


@dataclass
class Stores(InputPartition):
    """What one task reads."""

    stores: tuple[Store, ...]


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path within it; credentials are those of the machine's environment."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path)) if re.match(r"[a-z0-9]+:/", path) else (arrow_fs.LocalFileSystem(), path)


def _bytes(files: arrow_fs.FileSystem, path: str) -> bytes:
    with files.open_input_file(path) as f:
        return f.read()


def _there(files: arrow_fs.FileSystem, paths: list[str]) -> list[str]:
    return [i.path for i in files.get_file_info(paths) if i.type != arrow_fs.FileType.NotFound] if paths else []


def _is_store(name: str) -> bool:
    return name.endswith(".zarr")


def discover(path: str, depth: int = 3, per_source: int | None = None) -> list[Store]:
    """The stores under a folder, sorted by path: at most depth levels down, never inside a store, per_source of each source.

    Folders are listed level by level. A folder that is not there has no stores; one that is a store itself, or that holds
    zarr.json and no store, is the only one. Stores that share their name get the path below the root, joined by "__", as id.
    """
    files, root = _filesystem(path)
    root = root.rstrip("/") or "/"
    if files.get_file_info(root).type != arrow_fs.FileType.Directory:
        return []
    found: dict[str, list[str]] = {}
    queue = deque([(root, "", 1)]) if not _is_store(root) else deque()
    while queue:
        folder, source, level = queue.popleft()
        for info in sorted(files.get_file_info(arrow_fs.FileSelector(folder)), key=lambda i: i.path):
            if info.type != arrow_fs.FileType.Directory:
                continue
            of = source or ("" if _is_store(info.base_name) else info.base_name)
            if per_source is not None and len(found.get(of, ())) >= per_source:
                continue
            if _is_store(info.base_name):
                found.setdefault(of, []).append(info.path)
            elif level < depth:
                queue.append((info.path, of, level + 1))
    paths = [(p, source) for source, ps in found.items() for p in ps]
    if not paths and (_is_store(root) or _there(files, [f"{root}/zarr.json"])):
        paths = [(root, "")]
    bare = lambda name: re.sub(r"(?:\.zarr)+$", "", name)
    shared = Counter(bare(p.rsplit("/", 1)[-1]) for p, _ in paths)
    out = []
    for p, source in sorted(paths):
        name = bare(p.rsplit("/", 1)[-1])
        out.append(Store(p, name if shared[name] == 1 else bare(p[len(root) :].strip("/").replace("/", "__")), source))
    twice = [k for k, v in Counter(s.episode_id for s in out).items() if v > 1]
    if twice:
        raise ValueError(f"several stores would get the ids {twice[:5]}")
    return out


def _chosen(files: arrow_fs.FileSystem, store: str, keys: tuple[str, ...]) -> list[tuple[str, str]]:
    """(arm, key) of the arrays to read: the arms', else whatever fallback is there."""
    there = {p[len(store) + 1 : -len("/zarr.json")] for p in _there(files, [f"{store}/{k}/zarr.json" for k in keys])}
    return [(a, k) for a, k in ARM_KEYS.items() if k in there] or [(k, k) for k in keys if k in there and k not in ARM_KEYS.values()]


def _chunk_names(meta: dict) -> list[str]:
    separator = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    grid = (range(math.ceil(s / g)) for s, g in zip(meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]))
    return [separator.join(["c", *map(str, at)]) for at in itertools.product(*grid)]


def _array(files: arrow_fs.FileSystem, at: str) -> np.ndarray:
    meta = json.loads(_bytes(files, f"{at}/zarr.json"))
    return _decode(meta, {p[len(at) + 1 :]: _bytes(files, p) for p in _there(files, [f"{at}/{c}" for c in _chunk_names(meta)])})


def _rows(episode: str, arm: str, attributes: dict, pose: np.ndarray | None = None, error: str | None = None) -> pa.RecordBatch:
    """Rows of one pose array, or one row that names an error."""
    n = 1 if pose is None else len(pose)
    axes = [[None]] * 4 if pose is None else [np.arange(n), *(pose[:, c] for c in range(3))]
    columns = [[episode] * n, [arm] * n, *axes, *([attributes[k]] * n for k in ("total_frames", "fps", "task_name", "task_description", "embodiment")), [error] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BATCH.types)], schema=_BATCH)


def _attributes(raw: dict) -> dict:
    words = {k: str(raw.get(k) or d) for k, d in (("task_name", "unknown"), ("task_description", ""), ("embodiment", "unknown"))}
    return {"total_frames": int(raw.get("total_frames") or 0), "fps": float(raw.get("fps") or 30.0), **words}


def _poses(files: arrow_fs.FileSystem, store: Store, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of one store; whatever is wrong with it is a row of the ledger, not a failed run."""
    attributes = _attributes({})
    try:
        attributes = _attributes(json.loads(_bytes(files, f"{store.path}/zarr.json")).get("attributes") or {})
        chosen = _chosen(files, store.path, keys)
        if not chosen:
            yield _rows(store.episode_id, "", attributes, error="no pose array")
    except Exception as e:
        yield _rows(store.episode_id, "", attributes, error=f"unreadable store: {e!r}")
        return
    for arm, key in chosen:
        try:
            pose = _array(files, f"{store.path}/{key}")
            if pose.ndim < 2:
                raise ValueError("a pose array needs two dimensions")
            pose = pose.reshape(len(pose), -1)
            if pose.shape[1] < 3:
                raise ValueError("a pose array needs three channels")
            rows = _rows(store.episode_id, arm, attributes, pose)
        except Exception as e:
            rows = _rows(store.episode_id, arm, attributes, error=f"unreadable array: {e!r}")
        yield rows


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.keys = tuple(k for k in options.get("keys", ",".join((*ARM_KEYS.values(), *FALLBACK_KEYS))).split(",") if k)
        self.depth, self.together = int(options.get("depth", 3)), int(options.get("storespertask", 4))
        self.per_source = int(options["persource"]) if "persource" in options else None
        self.found = discover(self.path, self.depth, self.per_source)

    def partitions(self) -> list[Stores]:
        found = self.found
        return [Stores(tuple(found[i : i + self.together])) for i in range(0, len(found), self.together)] or [Stores(())]

    def read(self, partition: Stores) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.path)
        for one in partition.stores:
            yield from _poses(files, one, self.keys)


class EpisodeStores(DataSource):
    """spark.read.format("episode_stores").load(path), after spark.dataSource.register(EpisodeStores).

    Options: keys (arrays to read, comma-joined), depth (3 levels), perSource (no limit), storesPerTask (4). The folders are
    listed when the table is loaded; stores that come later are not part of it.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.stores = StoreReader({k.lower(): v for k, v in options.items()})

    @classmethod
    def name(cls) -> str:
        return "episode_stores"

    def schema(self) -> str:
        return POSES

    def reader(self, schema) -> StoreReader:
        return self.stores


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the session's default file system where it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    return full.toUri().getPath() if full.toUri().getScheme() == "file" else full.toString()


def read_poses(spark: SparkSession, path: str, keys: tuple[str, ...] = (*ARM_KEYS.values(), *FALLBACK_KEYS), depth: int = 3, per_source: int | None = None) -> DataFrame:
    """POSES rows of all stores under a folder (or of one store), see discover(). A folder that is not there gives no rows."""
    spark.dataSource.register(EpisodeStores)
    read = spark.read.format(EpisodeStores.name()).option("keys", ",".join(keys)).option("depth", depth)
    return (read if per_source is None else read.option("perSource", per_source)).load(_qualified(spark, path))


def stores(spark: SparkSession, path: str, depth: int = 3, per_source: int | None = None) -> DataFrame:
    """STORES rows: what discover() finds, a short row a store. No file is opened."""
    return spark.createDataFrame([(s.path, s.episode_id, s.source) for s in discover(_qualified(spark, path), depth, per_source)], STORES)


def fetch(listed: DataFrame, path: str, target: str, keys: tuple[str, ...] = (*ARM_KEYS.values(), *FALLBACK_KEYS), extras: tuple[str, ...] = ()) -> DataFrame:
    """Copies of the stores listed (see stores()) from the file system of path to <target>/<episode_id>.zarr, in tasks.

    Copied are the group's metadata, the pose arrays that read_poses would choose, and extras that are there. Returns a row
    a store: episode_id, files, bytes, error (null: whole). The group's metadata comes last, so that a copy that was cut off
    is no readable store, and a task that runs twice writes the same files.
    """
    spark = listed.sparkSession
    here, there = _qualified(spark, path), _qualified(spark, target)

    def copy(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (source, _), (sink, root) = _filesystem(here), _filesystem(there)
        for frame in frames:
            out = []
            for at, episode in zip(frame["path"], frame["episode_id"]):
                count = size = 0
                try:
                    names = ["zarr.json"]
                    extra = [k for k in extras if _there(source, [f"{at}/{k}/zarr.json"])]
                    for key in dict.fromkeys([*(k for _, k in _chosen(source, at, keys)), *extra]):
                        meta = json.loads(_bytes(source, f"{at}/{key}/zarr.json"))
                        inner = [f"{key}/zarr.json", *(f"{key}/{c}" for c in _chunk_names(meta))]
                        names = [p[len(at) + 1 :] for p in _there(source, [f"{at}/{n}" for n in inner])] + names
                    for name in names:
                        raw, goal = _bytes(source, f"{at}/{name}"), f"{root}/{episode}.zarr/{name}"
                        sink.create_dir(goal.rsplit("/", 1)[0], recursive=True)
                        with sink.open_output_stream(goal) as f:
                            f.write(raw)
                        count, size = count + 1, size + len(raw)
                    out.append((episode, count, size, None))
                except Exception as e:
                    out.append((episode, count, size, repr(e)))
            yield pd.DataFrame(out, columns=["episode_id", "files", "bytes", "error"])

    tasks = max(1, min(listed.count(), spark.sparkContext.defaultParallelism * 4))
    return listed.repartition(tasks, "path").mapInPandas(copy, "episode_id string, files long, bytes long, error string")


def split_errors(poses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames, and skipped (episode_id, reason)."""
    bad = poses.where("error IS NOT NULL").groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("reason"))
    return poses.where("error IS NULL").drop("error"), bad


def write_store(folder: str, poses: dict[str, np.ndarray], attributes: dict, chunk: int = 100, pad: bool = True) -> None:
    """Write a store on a local disk, padded to whole chunks: for tests and synthetic sets."""
    root = Path(folder)
    root.mkdir(parents=True)
    frames = min(len(p) for p in poses.values())
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"total_frames": frames, "fps": 30, **attributes}}))
    for key, pose in poses.items():
        rows = -(-len(pose) // chunk) * chunk if pad else len(pose)
        full = np.zeros((rows, pose.shape[1]))
        full[: len(pose)] = pose
        meta = {"zarr_format": 3, "node_type": "array", "shape": list(full.shape), "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunk, pose.shape[1]]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0.0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1}}]}
        (root / key).mkdir()
        (root / key / "zarr.json").write_text(json.dumps(meta))
        for i in range(-(-rows // chunk)):
            block = np.zeros((chunk, pose.shape[1]))
            part = full[i * chunk : (i + 1) * chunk]
            block[: len(part)] = part
            at = root / key / "c" / str(i)
            at.mkdir(parents=True)
            (at / "0").write_bytes(zstandard.ZstdCompressor().compress(block.tobytes()))


def synthetic_motion(kind: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """A motion of n frames, in metres: reach (straight, smooth), stir (circles), wipe (back and forth), zigzag."""
    t = np.linspace(0, 1, n)
    smooth = t**3 * (10 - 15 * t + 6 * t * t)
    start, end = rng.uniform(-0.5, 0.5, 3), rng.uniform(-0.5, 0.5, 3)
    base = start + smooth[:, None] * (end - start)
    if kind == "stir":
        base = start + 0.1 * np.column_stack([np.cos(12 * t), np.sin(12 * t), 0.2 * t])
    elif kind == "wipe":
        base = base + 0.15 * np.sin(18 * t)[:, None] * np.array([0, 1, 0])
    elif kind == "zigzag":
        base = base + 0.1 * (np.abs((t * 16) % 2 - 1) - 0.5)[:, None]
    elif kind != "reach":
        raise ValueError(f"unknown motion {kind}")
    return base + rng.normal(0, 0.0015, (n, 3))


def synthetic_set(folder: str, n: int = 12, seed: int = 42, broken: bool = False) -> None:
    """Seeded stores of mixed motions on a local disk; with `broken` also a dead, a millimetre, a sparse and a mostly lost one."""
    rng = np.random.default_rng(seed)
    kinds = ("reach", "stir", "wipe", "zigzag")
    still = np.tile([1.0, 0, 0, 0], (600, 1))
    for i in range(n):
        kind, frames = kinds[i % 4], int(rng.integers(120, 300))
        pose = np.hstack([synthetic_motion(kind, frames, rng), still[:frames]])
        write_store(f"{folder}/synth__{kind}__{i:04d}.zarr", {"left.obs_ee_pose": pose, **({"right.obs_ee_pose": np.hstack([synthetic_motion(kind, frames, rng), still[:frames]])} if i % 3 else {})}, {"task_name": kind, "task_description": f"synthetic {kind}", "embodiment": "synthetic"})
    if broken:
        dead = np.hstack([np.zeros((200, 3)), still[:200]])
        far = np.hstack([synthetic_motion("reach", 200, rng) * 1000 + 500, still[:200]])
        for name, share in (("dropout", 0.3), ("mostly_missing", 0.8)):
            p = np.hstack([synthetic_motion("wipe", 300, rng), still[:300]])
            p[rng.permutation(300)[: int(300 * share)], :3] = 0
            write_store(f"{folder}/synth__edge_{name}__0000.zarr", {"left.obs_ee_pose": p}, {"task_name": "edge"})
        write_store(f"{folder}/synth__edge_dead__0000.zarr", {"left.obs_ee_pose": dead}, {"task_name": "edge"})
        write_store(f"{folder}/synth__edge_millimetres__0000.zarr", {"left.obs_ee_pose": far}, {"task_name": "edge"})
