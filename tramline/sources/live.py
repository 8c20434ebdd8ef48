"""Python data sources: positions from a TCP socket, road documents by bounding box."""

from __future__ import annotations

import json
import socket
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from tramline.schemas import ELEMENTS, NAV
from tramline.sources import ndtp


class TcpPositions(DataSource):
    """spark.readStream.format("ndtp-tcp") with host and port: what a relay sends, frame by frame.

    df.write.format("ndtp-tcp").mode("append") sends the column frame to such a
    place, each task over a connection of its own.  With log, a folder that all
    executors share, and endpoints (host:port, comma-joined) the relays are read on
    executors, a task each, and what was read can be read again (_LoggedReader).
    Without, the driver reads one relay and delivery is at most once.
    """

    @classmethod
    def name(cls) -> str:
        return "ndtp-tcp"

    def schema(self) -> str:
        return NAV

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _LoggedReader(self.options) if "log" in self.options else super().streamReader(schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _TcpReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002
        return _TcpWriter(self.options, schema.names.index("frame"))


class _TcpWriter(DataSourceWriter):
    """Sends frames, `flush` at a time; a task that runs again sends its frames again."""

    def __init__(self, options: dict, column: int) -> None:
        self.at, self.flush, self.column = (options["host"], int(options["port"])), int(options.get("flush", 200)), column

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        waiting: list[bytes] = []
        with socket.create_connection(self.at, timeout=30) as out:
            for row in iterator:
                if row[self.column] is not None:
                    waiting.append(bytes(row[self.column]))
                if len(waiting) >= self.flush:
                    out.sendall(b"".join(waiting))
                    waiting = []
            out.sendall(b"".join(waiting))
        return WriterCommitMessage()


class _TcpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.at, self.socket, self.rest = (options["host"], int(options["port"])), None, b""
        self.most = int(options.get("maxBytes", 1 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"bytes": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.create_connection(self.at, timeout=5)
            self.socket.settimeout(0.2)
        data = b""
        try:
            while len(data) < self.most:
                if not (got := self.socket.recv(1 << 16)):  # the relay has closed; the next read connects again
                    self.socket.close()
                    self.socket = None
                    break
                data += got
        except TimeoutError:
            pass
        frames, self.rest = ndtp.split_stream(self.rest + data)
        return iter(ndtp.records(frames)), {"bytes": start["bytes"] + len(data)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([])

    def commit(self, end: dict) -> None:
        pass


class _Piece(InputPartition):
    """What one relay sends for one batch."""

    def __init__(self, endpoint: str, batch: int) -> None:
        self.endpoint, self.batch = endpoint, batch


class _LoggedReader(DataSourceStreamReader):
    """Batches of what relays send, each written to the log before its rows are given out.

    An offset is the number of the last batch.  A task takes one relay's batch
    from the log if it is there, else it connects, receives for `wait` seconds or
    maxBytes and writes what came, with the incomplete frame that the batch before
    left.  So a batch that runs again after a failure, a restart or on another
    executor gives the same rows.  A relay that is away gives nothing and is tried
    again with the next batch.  What a task had received but not written when it
    was lost is lost, unless the relay sends it again: the protocol has no acknowledgement.
    """

    def __init__(self, options: dict) -> None:
        self.endpoints = [e.strip() for e in (options.get("endpoints") or f"{options.get('host')}:{options.get('port')}").split(",")]
        self.log, self.wait, self.most = options["log"].rstrip("/"), float(options.get("wait", 1)), int(options.get("maxBytes", 4 << 20))

    def _at(self, endpoint: str, name: str) -> tuple[pafs.FileSystem, str]:
        store, root = pafs.FileSystem.from_uri(self.log) if ":" in self.log else (pafs.LocalFileSystem(), self.log)
        return store, f"{root}/{endpoint.replace(':', '_')}/{name}"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """One batch more than the log has."""
        last = 0
        for e in self.endpoints:
            store, folder = self._at(e, "")
            found = store.get_file_info(pafs.FileSelector(folder.rstrip("/"), allow_not_found=True))
            last = max([last, *(int(f.base_name) for f in found if f.base_name.isdigit())])
        return {"batch": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Piece(e, b) for b in range(start["batch"] + 1, end["batch"] + 1) for e in self.endpoints]

    def _load(self, endpoint: str, name: str) -> bytes | None:
        store, path = self._at(endpoint, name)
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return f.read()

    def _save(self, endpoint: str, name: str, data: bytes) -> None:
        store, path = self._at(endpoint, name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}.tmp") as f:
            f.write(data)
        store.move(f"{path}.tmp", path)

    def _receive(self, endpoint: str) -> bytes:
        host, _, port = endpoint.rpartition(":")
        data, until = b"", time.monotonic() + self.wait
        try:
            with socket.create_connection((host, int(port)), timeout=self.wait) as peer:
                while len(data) < self.most and (left := until - time.monotonic()) > 0:
                    peer.settimeout(left)
                    if not (got := peer.recv(1 << 16)):
                        break
                    data += got
        except OSError:  # away, or silent for the rest of the time
            pass
        return data

    def read(self, partition: _Piece) -> Iterator[tuple]:
        name = f"{partition.batch:010d}"
        data = self._load(partition.endpoint, name)
        if data is None:
            before = self._load(partition.endpoint, f"{partition.batch - 1:010d}.rest") or b""
            data = before + self._receive(partition.endpoint)
            self._save(partition.endpoint, f"{name}.rest", ndtp.split_stream(data)[1])
            self._save(partition.endpoint, name, data)  # from here on the batch is what it is
        return iter(ndtp.records(ndtp.split_stream(data)[0]))

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class _Box(InputPartition):
    def __init__(self, box: tuple[float, float, float, float]) -> None:
        self.box = box


class RoadsByBox(DataSource):
    """spark.read.format("roads-by-box") with south, west, north, east, endpoints (comma-joined) and splits.

    The box is read as 4 ** splits boxes, one partition each; an element on a
    border comes several times, so drop duplicates by (type, id).
    """

    @classmethod
    def name(cls) -> str:
        return "roads-by-box"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BoxReader(self.options)


class _BoxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.box = tuple(float(options[k]) for k in ("south", "west", "north", "east"))
        self.endpoints = options["endpoints"].split(",")
        self.n = 2 ** int(options.get("splits", 1))

    def partitions(self) -> list[InputPartition]:
        s, w, n, e = self.box
        dy, dx = (n - s) / self.n, (e - w) / self.n
        return [_Box((s + i * dy, w + j * dx, s + (i + 1) * dy, w + (j + 1) * dx)) for i in range(self.n) for j in range(self.n)]

    def read(self, partition: _Box) -> Iterator[tuple]:
        box = ",".join(f"{c:.6f}" for c in partition.box)
        asked = urllib.parse.urlencode({"data": f"[out:json][timeout:90];way[highway]({box});(._;>;);out body;"}).encode()
        last: Exception | None = None
        for url in self.endpoints:
            try:
                with urllib.request.urlopen(url, asked, timeout=100) as answer:
                    for x in json.load(answer)["elements"]:
                        yield tuple(x.get(k) for k in ("type", "id", "lat", "lon", "nodes", "tags"))
                return
            except OSError as error:
                last = error
        raise RuntimeError(f"no endpoint answered for {box}") from last
