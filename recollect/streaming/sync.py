"""Peer versions and their verdicts: one store's state, and its batch and streaming forms; the streaming signal fold."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SYNC_INTERVAL = 200  # fixed value: the least time between two sends


class Transport(Protocol):
    """What a store needs of a network: received (node, version) pairs, and ways to send them."""

    def receive(self) -> Iterable[tuple[int, int]]: ...

    def send_delta(self, node: int, version: int) -> None: ...

    def send_version(self, node: int, version: int) -> None: ...


@dataclass
class PeerVersions:
    """What one node knows: its own writes and version, and the highest version seen of each peer."""

    node: int
    writes: int = 0
    version: int = 0
    known: dict[int, int] = field(default_factory=dict)
    conflicts: list[tuple[int, int]] = field(default_factory=list)
    unsent: list[int] = field(default_factory=list)
    sent_at: int | None = None

    def record_change(self) -> None:
        self.version += 1
        self.writes += 1
        self.unsent.append(self.version)

    def verdict(self, node: int, version: int) -> str:
        """`self_packet`, `duplicate`, `stale`, `applied`, or `conflict` where the version is new and this node has state that the peer didn't cause: writes of its own or other peers' versions."""
        if node == self.node:
            return "self_packet"
        have = self.known.get(node)
        if version == 0 or version == have:
            return "duplicate"
        if have is not None and version < have:
            return "stale"
        independent = self.writes > 0 or any(n != node for n in self.known)
        self.known[node] = version
        if not independent:
            return "applied"
        if (node, version) not in self.conflicts:
            self.conflicts.append((node, version))
        return "conflict"

    def announce(self) -> list[tuple[int, int]]:
        """Own version first, then those of the peers: what others may learn through this node."""
        return [(self.node, self.version), *self.known.items()]

    def missing_after(self, peer: dict[int, int]) -> list[tuple[int, int]]:
        return sorted((n, v) for n, v in {**self.known, self.node: self.version}.items() if peer.get(n, 0) < v)

    def state(self) -> dict:
        return {"node": self.node, "writes": self.writes, "version": self.version, "known": dict(self.known)}

    def restore(self, state: dict) -> bool:
        """False, and nothing changes, for another node's state."""
        if state["node"] != self.node:
            return False
        self.writes, self.version, self.known = state["writes"], state["version"], dict(state["known"])
        return True

    def sync(self, now: int, transport: Transport) -> list[str]:
        """Verdicts of what came in; then, at most every SYNC_INTERVAL, the unsent versions that some known peer lacks and the own version."""
        found = [self.verdict(n, v) for n, v in transport.receive()]
        if self.sent_at is not None and now - self.sent_at < SYNC_INTERVAL:
            return found
        self.sent_at, unsent, self.unsent = now, self.unsent, []
        for v in unsent:
            if not self.known or any(have < v for have in self.known.values()):
                transport.send_delta(self.node, v)
        transport.send_version(self.node, self.version)
        return found


_VERDICTS = "local long, node long, seq long, verdict string"


def _judge(own: PeerVersions, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("seq")
    verdicts = []
    for node, value in zip(frame["node"], frame["value"], strict=True):
        if node == own.node and value > own.version:  # the store's own write
            own.version = own.writes = int(value)
            verdicts.append("written")
        else:
            verdicts.append(own.verdict(int(node), int(value)))
    return pd.DataFrame({"local": own.node, "node": frame["node"], "seq": frame["seq"], "verdict": verdicts})


def judge_versions(versions: DataFrame) -> DataFrame:
    """(local, node, seq, verdict) of a whole log (local, node, seq, value); rows of the local node are its own writes."""
    return versions.groupBy("local").applyInPandas(lambda key, frame: _judge(PeerVersions(key[0]), frame), _VERDICTS)


def apply_versions(versions: DataFrame) -> DataFrame:
    """The streaming form of `judge_versions`: late data are answered `stale`, never dropped; a micro-batch is judged in the order of `seq`."""

    def run(key, frames, state: GroupState):
        own = PeerVersions(key[0])
        if state.exists:
            own.version, nodes, counters = state.get
            own.writes, own.known = own.version, dict(zip(nodes, counters, strict=True))
        yield _judge(own, pd.concat(list(frames)))
        state.update((own.version, list(own.known), list(own.known.values())))

    return versions.groupBy("local").applyInPandasWithState(run, _VERDICTS, "version long, nodes array<long>, counters array<long>", "append", GroupStateTimeout.NoTimeout)


def fold_signals(log: DataFrame, start: float = 0.5) -> DataFrame:
    """(slot, importance) after each batch: the clamped fold, batch by batch in the order of `seq`."""

    def run(key, frames, state: GroupState):
        x = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values("seq")
        for d in rows["d_importance"]:
            x = min(max(x + d, 0.0), 1.0)
        state.update((x,))
        yield pd.DataFrame({"slot": [key[0]], "importance": [x]})

    return log.groupBy("slot").applyInPandasWithState(run, "slot long, importance double", "importance double", "update", GroupStateTimeout.NoTimeout)


def upkeep(stream: DataFrame, step: Callable[[DataFrame, int], None]):
    """A writer that calls one round of upkeep for each micro-batch."""
    return stream.writeStream.foreachBatch(step)
