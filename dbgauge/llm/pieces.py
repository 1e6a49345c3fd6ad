"""SentencePiece encoding with the original byte span of every piece, and decoding."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import map_texts, read_table
from dbgauge.llm.fim import CutIndex

MODEL = "piece_bpe_32k.model"
#: A model file may have this many bytes: it is sent to every task.
MODEL_LIMIT = 64 << 20

_SPACE, _SPACE_MARK = 0x20, "▁".encode()
# Types of pieces in a model file.
_UNKNOWN, _USER_DEFINED, _BYTE = 2, 4, 6


class CharacterMap:
    """The compiled character map of a model: a double array of byte strings, and what each of them becomes.

    Layout: four bytes with the length of the double array, its 32-bit units, then the replacements, each ended by a zero byte. The keys are read out
    level by level for all nodes at once. Texts are then searched for the first characters of keys only.
    """

    def __init__(self, blob: bytes):
        self.replacement: dict[bytes, bytes] = {}
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
            texts = blob[4 + size :]
            for key, at in self._keys(units):
                self.replacement[key] = texts[at : texts.index(b"\0", at)]
        self.longest = max(map(len, self.replacement), default=0)

    @staticmethod
    def _keys(units: np.ndarray):
        child = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 0x200) >> 6))
        nodes, keys = child(np.zeros(1, np.int64)), [b""]
        while len(nodes):
            steps = []
            for label in range(1, 256):
                places = nodes ^ label
                of = np.flatnonzero((places < len(units)) & ((units[np.minimum(places, len(units) - 1)] & 0x800000FF) == label))
                steps.append((of, places[of], np.full(len(of), label)))
            of, at, label = (np.concatenate(column) for column in zip(*steps))
            keys = [keys[o] + bytes((b,)) for o, b in zip(of.tolist(), label.tolist())]
            nodes = child(at)
            for k in np.flatnonzero(units[at] & 0x100).tolist():
                yield keys[k], int(units[nodes[k]] & 0x7FFFFFFF)

    def longest_prefix(self, raw: bytes, at: int) -> bytes | None:
        """The longest key that stands at a place."""
        for size in range(min(self.longest, len(raw) - at), 0, -1):
            if raw[at : at + size] in self.replacement:
                return raw[at : at + size]
        return None


@dataclass
class Aligned:
    """A normalised text, and for each of its bytes (and its end) the place in the original bytes it comes from."""

    text: bytes
    source: np.ndarray


class Normaliser:
    """What a model does to a text before it is cut into pieces, with the source of each byte.

    Replacements by the longest key of the character map; a user-defined piece stands as it is. Then spaces are thinned out, marked, and one is put in front (or
    behind), as the model says; a mark at the end goes too where spaces are thinned out. A replaced run is the source of all its bytes; other bytes are their own.
    """

    def __init__(self, spec, user_defined: list[bytes], space_behind: bool):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.thin, self.mark, self.lead = spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.add_dummy_prefix
        self.behind = space_behind
        self.own = sorted(user_defined, key=len, reverse=True)
        firsts = {key.decode()[0] for key in [*self.map.replacement, *user_defined]}
        self.start = re.compile(f"[{re.escape(''.join(sorted(firsts)))}]") if firsts else None

    def _replaced(self, text: str) -> Aligned:
        raw = text.encode()
        likely = [found.start() for found in self.start.finditer(text)] if self.start else []
        out, source, done, free = [], [], 0, 0
        for at in CutIndex(np.frombuffer(raw, np.uint8)).to_bytes(np.array(likely, np.int64)).tolist() if likely else []:
            if at < free:
                continue
            kept = next((piece for piece in self.own if raw.startswith(piece, at)), None)
            if kept is not None:
                free = at + len(kept)
            elif (key := self.map.longest_prefix(raw, at)) is not None:
                new = self.map.replacement[key]
                out += [raw[done:at], new]
                source += [np.arange(done, at), np.full(len(new), at)]
                done = free = at + len(key)
        return Aligned(b"".join([*out, raw[done:]]), np.concatenate([*source, np.arange(done, len(raw) + 1)]))

    def __call__(self, text: str) -> Aligned:
        made = self._replaced(text)
        data, source = np.frombuffer(made.text, np.uint8), made.source
        if self.thin:
            space = data == _SPACE
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            data, source = data[keep], np.append(source[:-1][keep], source[-1])
        if not len(data):
            return Aligned(b"", np.zeros(1, np.int64))
        space, body = _SPACE_MARK if self.mark else b" ", data.tobytes()
        if self.mark:
            body = body.replace(b" ", space)
            source = np.append(np.repeat(source[:-1], np.where(data == _SPACE, len(space), 1)), source[-1])
        if self.lead and not self.behind:
            body, source = space + body, np.append(np.full(len(space), source[0] if self.thin else 0), source)
        if self.thin:
            size = len(body)
            while size and body.endswith(space, 0, size):
                size -= len(space)
            body, source = body[:size], source[: size + 1]
        if self.lead and self.behind:
            body, source = body + space, np.append(source, np.full(len(space), source[-1]))
        return Aligned(body, source)


class Encoder:
    """One model: ids of a text, the span of each in its original bytes, and the text of ids.

    The normaliser above makes the text; the library, with a copy of the model that normalises no more, cuts it into pieces. Their
    lengths, read from the vocabulary by id, lead to places in the normalised text, and these to the original bytes.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as protobuf

        proto = protobuf.ModelProto()
        proto.ParseFromString(model)
        kinds = np.array([piece.type for piece in proto.pieces])
        self.normalise = Normaliser(
            proto.normalizer_spec, [p.piece.encode() for p in proto.pieces if p.type == _USER_DEFINED], proto.trainer_spec.treat_whitespace_as_suffix
        )
        self.sizes = np.where(kinds == _BYTE, 1, [len(piece.piece.encode()) for piece in proto.pieces])
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0]) if (kinds == _UNKNOWN).any() else -1
        self.decoder = SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.cutter = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = self.decoder.eos_id()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the end id last, and the byte edges of their spans: piece i is bytes edges[i] to edges[i + 1]."""
        aligned = self.normalise(text or "")
        whole = aligned.text.decode()
        ids = self.cutter.encode(whole, return_type="numpy")
        if (ids == self.unknown).any():  # of a model without byte pieces: an unknown piece is as long as what it stands for
            sizes = np.array([len(piece.encode()) for piece in self.cutter.encode(whole, out_type=str)], np.int64)
        else:
            sizes = self.sizes[ids]
        places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if places[-1] != len(aligned.text):
            raise ValueError("pieces do not cover the normalised text")
        edges = aligned.source[places]
        return (np.append(ids, self.end), np.append(edges, edges[-1])) if self.end >= 0 else (ids, edges)

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"the model has more than {MODEL_LIMIT} bytes")
    return model


def _int_lists(column: pa.Array) -> list[list[int]]:
    """The lists of a column, by one conversion of all their numbers."""
    values, edges = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    return [values[a:b].tolist() for a, b in zip(edges, edges[1:])]


def _with_encoder(frame: DataFrame, column: str, model: str, one, fields: str, cells=pa.Array.to_pylist) -> DataFrame:
    """Append what ``one(encoder, cell)`` makes of each cell; the model is read once, here, and sent to the tasks."""
    shipped = frame.sparkSession.sparkContext.broadcast(load_model(model))

    def make():
        encoder = Encoder(shipped.value)
        return lambda cells: [list(made) for made in zip(*[one(encoder, cell) for cell in cells])]

    return map_texts(frame, column, make, fields, cells)


def encode_texts(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Append ids (array of int, the model's end id last) and edges (array of int), without a shuffle.

    Piece i of a text comes from its UTF-8 bytes edges[i] to edges[i + 1]: the spans follow each other from the first byte that is not thinned out.
    What normalisation adds has an empty span, the end id too. ids are those of the library. A null text is an empty one: only the
    end id. ``model`` is the path of a model file of at most MODEL_LIMIT bytes. Other columns stay, those named ids or edges are replaced.
    """

    def one(encoder: Encoder, cell: str | None) -> tuple:
        ids, edges = encoder.encode(cell)
        return ids.astype(np.int32), edges.astype(np.int32)

    return _with_encoder(documents, text, model, one, "ids array<int>, edges array<int>")


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Append decoded (string): the library's text of the ids; empty for null or no ids."""
    return _with_encoder(encoded, ids, model, lambda encoder, cell: (encoder.decode(cell),), "decoded string", _int_lists)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path(MODEL)
    encoded = encode_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    digests = encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids"
    )
    decoded = decode_ids(digests, model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
