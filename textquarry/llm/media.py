"""Interleaved document sequences.

HTML is parsed into an ordered list of text and media-reference items; media live in a store of their own, one row per
digest; joins on the digest resolve the references, and position and caption stay with their item.

A stored payload is a binary PGM image of rows of 24 eight-bit samples. Null HTML is an empty sequence, a reference
that the store doesn't hold keeps its item with no payload, null keys and repeated rows are kept, an empty table gives no rows. What stands in
scripts, styles, templates and noscript is no item, be it text or media, nor is a media element without a reference; of a player's several
sources the first counts. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import crc, dealt_join, hot_keys, scratch, table, whole_text, with_columns
from textquarry.sources.html import TolerantParser

BLOCK, SIDE, PAD = 576, 24, 255
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "td", "th", "tr", "table", "blockquote", "pre", "nav", "footer", "header", "figure", "figcaption", "title"}
MEDIA = {"img", "video", "audio", "source", "embed"}
PLAYERS = {"video", "audio"}


class _Sequence(TolerantParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.muted = [], [], 0
        self.figures: list[tuple[list[int], list[str]]] = []  # open figures: their media's places and their captions' texts
        self.captions, self.playing = 0, None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text and self.captions and self.figures:
            self.figures[-1][1].append(text)
        elif text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.muted += 1
        if self.muted:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.captions += 1
        elif tag in MEDIA:
            self.media(tag, dict(attrs))

    def media(self, tag, a):
        ref = a.get("data-digest") or a.get("src")
        if tag in PLAYERS:
            self.playing = bool(ref)
        elif tag == "source" and self.playing is not None:
            if self.playing:  # another form of what plays already
                return
            self.playing = bool(ref)
        if not ref:
            return
        self.flush()
        self.items.append(["media", None, ref.removeprefix("sha256:"), a.get("alt") or a.get("title")])
        if self.figures:
            self.figures[-1][0].append(len(self.items) - 1)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.muted = max(0, self.muted - 1)
        if self.muted:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.captions = max(0, self.captions - 1)
        elif tag == "figure" and self.figures:
            self.caption()
        elif tag in PLAYERS:
            self.playing = None

    def caption(self):
        """A figure's caption belongs to each of its media, wherever it stands; without media it is text."""
        places, said = self.figures.pop()
        for i in places:
            self.items[i][3] = " ".join(said) or self.items[i][3]
        if said and not places:
            self.items.append(["text", " ".join(said), None, None])

    def handle_data(self, data):
        if not self.muted:
            self.words.append(data)

    def end(self):
        self.close()
        self.flush()
        while self.figures:
            self.caption()


def parse(html: str | None) -> list[tuple]:
    """(position, kind, text, digest, caption) of each item in order."""
    p = _Sequence()
    p.feed(html or "")
    p.end()
    return [(i, *x) for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, items: the ordered items of each page."""
    names = [x.split(":")[0] for x in ITEM[7:-1].split(",")]

    def make():
        return lambda b: [[[dict(zip(names, x, strict=True)) for x in parse(t)] for t in b.column("h").to_pylist()]]

    return with_columns(pages.select(key, F.col(html).alias("h")), f"items array<{ITEM}>", make, drop=("h",))


def resolve(seqs: DataFrame, media: DataFrame, key: str = "page_id", digest: str = "digest", hot: DataFrame | None = None) -> DataFrame:
    """One row per item, with the store's columns joined on the digest. ``media`` has one row per digest; text items pass by the join. ``hot``: the
    digests that very many items share (hot_keys), dealt over salts."""
    items = seqs.select(key, F.explode("items").alias("i")).select(key, "i.*")
    refs = items.where("kind = 'media'")
    found = refs.join(media, digest, "left") if hot is None else dealt_join(refs, media, digest, hot, F.struct(key, "position"), "left")
    return found.unionByName(items.where("kind <> 'media'"), allowMissingColumns=True)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with 255 to a positive multiple of 576, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    return raw + bytes([PAD]) * (max(BLOCK, -(-n // BLOCK) * BLOCK) - n), n


def to_pgm(samples: bytes, n: int) -> bytes:
    """A binary PGM image of rows of 24 samples; the comment keeps the unpadded length."""
    return b"P5\n# n=%d\n%d %d\n255\n" % (n, SIDE, len(samples) // SIDE) + samples


def from_pgm(stored: bytes) -> tuple[bytes, int]:
    kind, note, shape, depth, samples = stored.split(b"\n", 4)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored payload")
    return samples, int(note[4:])


def feature(samples: bytes) -> str:
    """Of all samples: the share of each of 16 ranges of values in thousandths, the mean, and the mean step between rows."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    rows = x.reshape(-1, SIDE).mean(axis=1)
    step = float(np.abs(np.diff(rows)).mean()) if len(rows) > 1 else 0.0
    return "-".join(map(str, share.tolist())) + f"|{x.mean():.3f}|{step:.3f}"


def store_media(docs: DataFrame, where: str, text: str = "text") -> DataFrame:
    """Writes the distinct payloads of each task as rows (digest, media) to the shared folder and returns that store. A payload that
    several tasks met is there several times; readers take any."""

    def run(batches):
        seen = set()
        for b in batches:
            digests, media = [], []
            for t in b.column("t").to_pylist():
                samples, n = payload(t)
                digest = hashlib.sha256(samples[:n]).hexdigest()
                if digest not in seen:
                    if len(seen) >= 1_000_000:  # the memory of a task stays bounded; repeats are allowed
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    media.append(to_pgm(samples, n))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    docs.select(whole_text(text).alias("t")).mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema("digest string, media binary").parquet(where)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def stored_features(media: bytes) -> tuple:
    """FEATURES of a stored form, from its bytes alone."""
    samples, n = from_pgm(media)
    return n, len(samples), hashlib.sha256(samples).hexdigest(), crc(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)


def read_media(store: DataFrame) -> DataFrame:
    """One row per digest with what its stored bytes hold. Only these short rows are shuffled, never payloads."""

    def make():
        return lambda b: list(zip(*[stored_features(m) for m in b.column("media").to_pylist()], strict=True)) if len(b) else [[] for _ in NAMES]

    read = with_columns(store.select("digest", "media"), FEATURES, make, drop=("media",))
    return read.groupBy("digest").agg(F.max(F.struct(*NAMES)).alias("m")).select("digest", "m.*")


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A page of a document: its lines as paragraphs, and after the first one its payload as a figure with a caption."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(safe, "\n")
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>"))
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "</p><p>")
    return F.concat(F.lit("<article><p>"), F.get(lines, F.lit(0)), figure, rest, F.lit("</p></article>"))


def op4_interleaved_media(spark, sf_dir: str) -> DataFrame:
    """Further columns: position of the payload in its page's sequence, n_items of the sequence, caption (the key; empty for a null one)."""
    docs = table(spark, sf_dir, "documents")
    media = read_media(store_media(docs, scratch(spark, "media")))
    digest = F.sha2(whole_text("text"), 256)
    counts = docs.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "digest", "n", docs.count())
    pages = docs.select("doc_id", page_of(whole_text("text"), digest, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("html"))
    seqs = sequences(pages, key="doc_id")
    seqs = seqs.select(F.struct("doc_id", F.size("items").alias("n_items")).alias("doc"), F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    return resolve(seqs, media, key="doc", hot=hot).select("doc.doc_id", *NAMES, "position", "doc.n_items", "caption")
