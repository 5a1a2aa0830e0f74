"""Items from container images and mobile packages (SRC-13 to SRC-17)."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import os
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.sources.content import normalized, printable, strings, text_of

ENTRY_BYTES, ARCHIVE_BYTES, ENTRIES = 64 << 20, 1 << 30, 200_000
TEXT = tuple(sorted("bundle cfg conf css env graphql gradle htm html ini js json kt md pem plist properties smali strings toml ts txt xml yaml yml".split()))
BINARY_STRINGS = tuple(sorted("arsc db dex dll dylib nib realm so sqlite".split()))
SKIP = tuple(sorted("aac avif car gif heic ico jpeg jpg m4a mp3 mp4 ogg otf png ttf wav webm webp woff woff2".split()))


def _open(b: bytes) -> bytes:
    return gzip.decompress(b) if b[:2] == b"\x1f\x8b" else lzma.decompress(b) if b[:6] == b"\xfd7zXZ\0" else b


def _layers(batches: Iterator[pa.RecordBatch], read=None) -> Iterator[pa.RecordBatch]:
    """Entries of layers, one layer in memory at a time; read(bytes) instead of the bytes, if it is given."""
    for batch in batches:
        for row in zip(*batch.columns):
            label, layer, content = (x.as_py() for x in row)
            rows: list[tuple] = []
            held = 0
            try:
                with tarfile.open(fileobj=io.BytesIO(_open(content or b"")), mode="r:", ignore_zeros=True) as tar:
                    for seq, e in enumerate(tar):
                        kind = "dir" if e.isdir() else "file" if e.isfile() else "link"
                        data = tar.extractfile(e).read() if e.isfile() and e.size <= ENTRY_BYTES else None
                        rows.append((label, layer, seq, e.name.removeprefix("./").strip("/"), kind, e.size, read(data) if read and data is not None else data))
                        held += len(data or b"")
                        tar.members = []  # else a layer's entries are all kept
                        if held > BATCH_BYTES:
                            yield _batch(rows, read)
                            rows, held = [], 0
            except (tarfile.TarError, EOFError, OSError, lzma.LZMAError, zlib.error) as e:  # the entries before the damage stay
                rows.append((label, layer, -1, f"{type(e).__name__}: {e}"[:200], "error", 0, None))
            if rows:
                yield _batch(rows, read)


_LAYER = "label string, layer int, seq int, path string, entry string, size long, "
BATCH_BYTES = 4 << 20


def _batch(rows: list[tuple], read) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string() if read else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["label", "layer", "seq", "path", "entry", "size", "text" if read else "content"])


def layer_entries(layers: DataFrame) -> DataFrame:
    """Tar entries of layers: label, layer, content (tar, gzip or xz).  A damaged layer ends in an entry of kind error that says why."""
    return layers.select("label", "layer", "content").mapInArrow(_layers, _LAYER + "content binary")


def layer_texts(layers: DataFrame) -> DataFrame:
    """layer_entries() with the text of each in place of its bytes, which never leave the pass that reads them."""
    return layers.select("label", "layer", "content").mapInArrow(lambda batches: _layers(batches, text_of), _LAYER + "text string")


def layer_items(entries: DataFrame, instructions: DataFrame | None = None, most_bytes: int = 10 << 20) -> DataFrame:
    """Items label|layerN:path of layer_entries() or layer_texts(), with the step that made the layer in meta."""
    rows = entries.where(F.col("size").between(1, most_bytes) & (F.col("entry") == "file"))
    step = F.lit(None).cast("string")
    if instructions is not None:
        rows, step = rows.join(instructions, ["label", "layer"], "left"), F.col("instruction")
    path = F.concat("label", F.lit("|layer"), F.col("layer").cast("string"), F.lit(":"), "path")
    meta = F.when(step.isNotNull(), F.create_map(F.lit("instruction"), step))
    text = F.col("text") if "text" in rows.columns else normalized(F.col("content"))
    return rows.select(F.xxhash64("label", "layer", "path").alias("item_id"), text.alias("text"), F.lit("code").alias("source"), path.alias("path"), meta.alias("meta")).where("text IS NOT NULL")


_CONFIG = (
    "config struct<Env:array<string>,Labels:map<string,string>,Entrypoint:array<string>,Cmd:array<string>,OnBuild:array<string>,User:string,WorkingDir:string,StopSignal:string,Healthcheck:struct<Test:array<string>>>, "
    "history array<struct<created_by:string,comment:string,empty_layer:boolean>>"
)


def config_items(configs: DataFrame) -> DataFrame:
    """Items of an image's settings and of each step of its history.  configs: label, config (JSON)."""
    c = configs.select("label", F.from_json("config", _CONFIG).alias("c")).select("label", "c.config", "c.history")
    label_lines = F.transform(F.array_sort(F.map_entries("config.Labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    fields: dict[str, Column] = {
        "env": F.array_join("config.Env", "\n"), "labels": F.array_join(label_lines, "\n"), "entrypoint": F.array_join("config.Entrypoint", " "), "cmd": F.array_join("config.Cmd", " "), "onbuild": F.array_join("config.OnBuild", "\n"),
        "user": F.col("config.User"), "workingdir": F.col("config.WorkingDir"), "stopsignal": F.col("config.StopSignal"), "healthcheck": F.array_join("config.Healthcheck.Test", " "),
    }
    parts = c.select("label", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("text")) for k, v in fields.items()))).alias("p")).select("label", "p.k", "p.text")
    steps = c.select("label", F.posexplode("history").alias("i", "h")).select("label", F.concat(F.lit("history"), F.col("i").cast("string")).alias("k"), F.concat_ws("\n", "h.created_by", F.nullif("h.comment", F.lit(""))).alias("text"))
    rows = parts.unionByName(steps).where("text IS NOT NULL AND text != ''")
    path = F.concat("label", F.lit("|image:"), "k")
    return rows.select(F.xxhash64("label", "k").alias("item_id"), "text", F.lit("code").alias("source"), path.alias("path"), F.lit(None).cast("map<string,string>").alias("meta"))


def image_parts(archive: bytes) -> tuple[dict, list[bytes]]:
    """Config and layers, lowest first, of an image saved as a tar."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
        manifest = json.load(tar.extractfile("manifest.json"))[0]
        return json.load(tar.extractfile(manifest["Config"])), [tar.extractfile(x).read() for x in manifest["Layers"]]


def oci_images(folder: str, platform: str | None = None) -> list[tuple[str, str, list[str]]]:
    """(label, config file, layer files, lowest first) of each image of an OCI folder; indexes within the index are opened."""
    blob = lambda digest: os.path.join(folder, "blobs", *digest.split(":", 1))
    out, todo, seen = [], [(e, "") for e in json.load(open(os.path.join(folder, "index.json")))["manifests"]], set()
    while todo:
        entry, name = todo.pop(0)
        if entry["digest"] in seen:
            continue
        seen.add(entry["digest"])
        doc = json.load(open(blob(entry["digest"])))
        on = entry.get("platform") or {}
        of = "/".join(filter(None, (on.get("os"), on.get("architecture"), on.get("variant"))))
        name = entry.get("annotations", {}).get("org.opencontainers.image.ref.name", name)
        if "manifests" in doc:
            todo += [(e, name) for e in doc["manifests"]]
        elif on.get("os") != "unknown" and (platform is None or not of or of == platform):  # attestations have no system
            out.append((f"{name or entry['digest'][7:19]}{'@' + of if of else ''}", blob(doc["config"]["digest"]), [blob(x["digest"]) for x in doc["layers"]]))
    return out


def oci_layers(spark: SparkSession, folder: str, platform: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Configs (label, config) and layers (label, layer, content) of an OCI folder; layers are read by the executors."""
    found = oci_images(folder, platform)
    configs = spark.createDataFrame([(label, open(config).read()) for label, config, _ in found], "label string, config string")
    places = spark.createDataFrame([(label, k, path, 0, -1) for label, _, layers in found for k, path in enumerate(layers)], _PLACE)
    return configs, read_layers(places)


def saved_layers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of images saved as a tar: only its headers and configs are read here, the executors read each layer from where it lies."""
    configs, places = [], []
    with tarfile.open(path, "r:") as tar:
        at = {m.name: m for m in tar}
        for k, image in enumerate(json.load(tar.extractfile("manifest.json"))):
            label = (image.get("RepoTags") or [f"image{k}"])[0]
            configs.append((label, tar.extractfile(image["Config"]).read().decode()))
            for n, layer in enumerate(image["Layers"]):
                m = at[layer]
                while m.issym() or m.islnk():
                    m = at[os.path.normpath(os.path.join(os.path.dirname(m.name), m.linkname)) if m.issym() else m.linkname]
                places.append((label, n, path, m.offset_data, m.size))
    return spark.createDataFrame(configs, "label string, config string"), read_layers(spark.createDataFrame(places, _PLACE))


_PLACE = "label string, layer int, path string, start long, size long"


def read_layers(places: DataFrame) -> DataFrame:
    """label, layer, content of layers that lie in files all executors see, a layer at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, layer, path, start, size in zip(*(batch.column(k).to_pylist() for k in range(5))):
                with open(path, "rb") as f:
                    f.seek(start)
                    data = f.read(size) if size >= 0 else f.read()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((label, pa.string()), (layer, pa.int32()), (data, pa.binary()))], ["label", "layer", "content"])

    return places.repartition("label", "layer").mapInArrow(run, "label string, layer int, content binary")


def classify(name: Column) -> Column:
    """How an entry of a package is read: text, strings or skip."""
    ext = F.when(F.contains(F.substring_index(name, "/", -1), F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return F.when(F.endswith(name, F.lit("/")) | ext.isin(*SKIP), "skip").when(ext.isin(*BINARY_STRINGS), "strings").when(ext.isin(*TEXT), "text").otherwise("strings")


def kind_of(name: str) -> str:
    """classify() of one name."""
    last = name.rpartition("/")[2]
    ext = last.rpartition(".")[2].lower() if "." in last else ""
    return "skip" if name.endswith("/") or ext in SKIP else "strings" if ext in BINARY_STRINGS else "text" if ext in TEXT else "strings"


def _entry_text(name: str, data: bytes) -> str | None:
    kind = kind_of(name)
    if kind == "skip":
        return None
    text = text_of(data) if kind == "text" else None
    return printable(data) if text is None else text


def _unzip(batches: Iterator[pa.RecordBatch], read=None) -> Iterator[pa.RecordBatch]:
    """Entries of packages, one package in memory at a time; read(name, bytes) instead of the bytes, if it is given."""
    for batch in batches:
        for row in zip(*batch.columns):
            archive, content = (x.as_py() for x in row)
            total, rows, held = 0, [], 0
            try:
                z = zipfile.ZipFile(io.BytesIO(content or b""))
            except zipfile.BadZipFile:
                yield _entries([(archive, 0, None, 0, None, "not a package")], read)
                continue
            for k, e in enumerate(z.infolist()):
                total += e.file_size
                if k >= ENTRIES or total > ARCHIVE_BYTES:
                    rows.append((archive, k, None, 0, None, "cut at its budget"))
                    break
                if not e.is_dir() and e.file_size <= ENTRY_BYTES:
                    data = z.read(e)
                    rows.append((archive, k, e.filename, e.file_size, read(e.filename, data) if read else data, None))
                    held += len(data)
                    if held > BATCH_BYTES:
                        yield _entries(rows, read)
                        rows, held = [], 0
            if rows:
                yield _entries(rows, read)


def _entries(rows: list[tuple], read) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string() if read else pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["archive", "seq", "name", "size", "text" if read else "content", "error"])


def package_entries(archives: DataFrame) -> DataFrame:
    """Entries of packages: archive, content.  A package that can't be read or is cut has a row that says so."""
    return archives.select("archive", "content").mapInArrow(_unzip, "archive string, seq int, name string, size long, content binary, error string")


def package_texts(archives: DataFrame) -> DataFrame:
    """package_entries() with the text of each in place of its bytes, which never leave the pass that reads them; null for what isn't read."""
    return archives.select("archive", "content").mapInArrow(lambda batches: _unzip(batches, _entry_text), "archive string, seq int, name string, size long, text string, error string")


def package_items(entries: DataFrame) -> DataFrame:
    """Items archive!name of package_entries() or package_texts(): texts, or the printable strings of binary entries and of texts that turn out binary."""
    rows, text = entries.where("error IS NULL"), F.col("text")
    if "text" not in entries.columns:
        rows = rows.withColumn("kind", classify(F.col("name"))).where("kind != 'skip'")
        text = F.coalesce(F.when(F.col("kind") == "text", normalized(F.col("content"))), strings(F.col("content")))
    return rows.select(F.xxhash64("archive", "seq").alias("item_id"), text.alias("text"), F.lit("code").alias("source"), F.concat("archive", F.lit("!"), "name").alias("path"), F.lit(None).cast("map<string,string>").alias("meta")).where("text != ''")
