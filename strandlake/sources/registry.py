"""A schema registry's client, its cache, subject names and register modes. All of it runs on the driver."""

from __future__ import annotations

import base64
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import Enum
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import Column

from ..errors import LakeError, RegistryError, SchemaPending
from ..functions.jsonschema import valid_json
from . import framing
from .codecs import Codec


class RegisterMode(Enum):
    """How a writer gets its schema's id: registering it, looking it up, or taking the subject's latest."""

    AUTO_REGISTER = "auto"
    LOOKUP_ONLY = "lookup"
    USE_LATEST = "latest"


class Role(Enum):
    KEY = "key"
    VALUE = "value"


SubjectName = Callable[[str, Role], str]


def topic_name(topic: str, role: Role) -> str:
    """The default subject: the topic, then -key or -value."""
    return f"{topic}-{role.value}"


@dataclass(frozen=True)
class Schema:
    """Text, kind (AVRO, JSON, PROTOBUF), and references (name, subject, version) with their texts once resolved."""

    text: str
    kind: str = "AVRO"
    references: tuple[tuple[str, str, int], ...] = ()
    resolved: tuple[Schema, ...] = ()

    def body(self) -> dict[str, Any]:
        out: dict[str, Any] = {"schema": self.text}
        if self.kind != "AVRO":
            out["schemaType"] = self.kind
        if self.references:
            out["references"] = [{"name": n, "subject": s, "version": v} for n, s, v in self.references]
        return out


class RegistryClient:
    """HTTP calls. Transport errors, 429 and 5xx are tried again twice, after a growing pause."""

    def __init__(self, url: str, user: str | None = None, password: str | None = None, token: str | None = None, headers: dict[str, str] | None = None, timeout: float = 30, retries: int = 2, pause: float = 0.1):
        self.url, self.timeout, self.retries, self.pause = url.rstrip("/"), timeout, retries, pause
        self.headers = {"Accept": "application/vnd.schemaregistry.v1+json, application/json", "Content-Type": "application/vnd.schemaregistry.v1+json", **(headers or {})}
        if token:
            self.headers["Authorization"] = f"Bearer {token}"
        elif user is not None:
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()

    def _call(self, method: str, *path: str, body: dict | None = None, query: str = "") -> Any:
        url = self.url + "".join("/" + urllib.parse.quote(str(p), safe="") for p in path) + query
        data = json.dumps(body).encode() if body is not None else None
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(url, data=data, method=method, headers=self.headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read() or b"null")
            except urllib.error.HTTPError as e:
                if attempt == self.retries or not (e.code == 429 or e.code >= 500):
                    raise RegistryError(f"{method} {url}: {e.code} {e.read()[:500].decode('utf-8', 'replace')}", e.code) from e
            except (urllib.error.URLError, OSError, json.JSONDecodeError) as e:
                if attempt == self.retries:
                    raise RegistryError(f"{method} {url}: {e}") from e
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def register(self, subject: str, schema: Schema) -> int:
        return self._call("POST", "subjects", subject, "versions", body=schema.body())["id"]

    def lookup(self, subject: str, schema: Schema) -> int:
        return self._call("POST", "subjects", subject, body=schema.body())["id"]

    def latest(self, subject: str) -> dict[str, Any]:
        return self.version(subject, "latest")

    def latest_id(self, subject: str) -> int:
        return self.latest(subject)["id"]

    def version(self, subject: str, version: int | str) -> dict[str, Any]:
        return self._call("GET", "subjects", subject, "versions", str(version))

    def subjects(self) -> list[str]:
        return self._call("GET", "subjects")

    def versions(self, subject: str) -> list[int]:
        return self._call("GET", "subjects", subject, "versions")

    def schema(self, number: int) -> Schema:
        return _schema(self._call("GET", "schemas", "ids", str(number)))

    def resolved(self, number: int) -> Schema:
        """The schema with the texts of all it refers to, those it depends on first."""
        found: dict[tuple[str, int], Schema] = {}

        def follow(s: Schema, open_: tuple) -> None:
            for _, subject, version in s.references:
                at = (subject, version)
                if at in open_:
                    raise LakeError(f"schema references go round: {subject}")
                if at not in found:
                    own = _schema(self.version(subject, version))
                    follow(own, (*open_, at))
                    found[at] = own

        s = self.schema(number)
        follow(s, ())
        return Schema(s.text, s.kind, s.references, tuple(found.values()))

    def compatibility(self, subject: str | None = None) -> str:
        answer = self._call("GET", "config", *([subject] if subject else []))
        return answer.get("compatibilityLevel") or answer["compatibility"]

    def set_compatibility(self, level: str, subject: str | None = None) -> str:
        return self._call("PUT", "config", *([subject] if subject else []), body={"compatibility": level})["compatibility"]

    def delete_subject(self, subject: str, permanent: bool = False) -> list[int]:
        return self._call("DELETE", "subjects", subject, query="?permanent=true" if permanent else "")

    def delete_version(self, subject: str, version: int, permanent: bool = False) -> int:
        return self._call("DELETE", "subjects", subject, "versions", str(version), query="?permanent=true" if permanent else "")


def _schema(answer: dict[str, Any]) -> Schema:
    return Schema(answer["schema"], answer.get("schemaType", "AVRO"), tuple((r["name"], r["subject"], r["version"]) for r in answer.get("references", [])))


@dataclass
class SchemaCache:
    """Ids by subject, writer schemas by id. What codecs ask for is here before a batch is decoded.

    ``intern`` notes which schema a subject is to be written with (the first one counts); ``prewarm`` asks the
    registry for all their ids. In mode USE_LATEST the registry's own text is kept for the latest id.
    """

    client: RegistryClient
    mode: RegisterMode = RegisterMode.AUTO_REGISTER
    threads: int = 4
    wanted: dict[str, Schema] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    schemas: dict[int, Schema] = field(default_factory=dict)
    _pending: dict[int, Future] = field(default_factory=dict, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        self._pool = ThreadPoolExecutor(self.threads, thread_name_prefix="registry")

    def intern(self, subject: str, schema: Schema) -> None:
        self.wanted.setdefault(subject, schema)

    def _resolve(self, subject: str) -> int:
        schema = self.wanted[subject]
        if self.mode is RegisterMode.USE_LATEST:
            latest = self.client.latest(subject)
            number, schema = latest["id"], self.client.resolved(latest["id"])
        elif self.mode is RegisterMode.LOOKUP_ONLY:
            number = self.client.lookup(subject, schema)
        else:
            number = self.client.register(subject, schema)
        with self._lock:
            self.ids[subject] = number
            self.schemas.setdefault(number, schema)
        return number

    def prewarm_report(self) -> dict[str, Exception | int]:
        """The id, or what went wrong, of each subject that had none."""
        todo = {s: self._pool.submit(self._resolve, s) for s in self.wanted if s not in self.ids}
        out: dict[str, Exception | int] = {}
        for s, f in todo.items():
            try:
                out[s] = f.result()
            except Exception as e:  # reported, not swallowed: the caller gets it
                out[s] = e
        return out

    def prewarm(self) -> None:
        for outcome in self.prewarm_report().values():
            if isinstance(outcome, Exception):
                raise outcome

    def id_for(self, subject: str) -> int:
        if subject not in self.ids:
            raise LakeError(f"subject {subject} has no schema id; prewarm the cache")
        return self.ids[subject]

    def seed(self, subject: str, number: int, schema: Schema) -> None:
        self.ids[subject], self.schemas[number] = number, schema

    def fetch(self, numbers: Iterable[int]) -> dict[int, Schema]:
        """The writer schemas of all the ids, those that are missing fetched side by side."""
        missing = [n for n in set(numbers) if n not in self.schemas]
        for n, s in zip(missing, self._pool.map(self.client.resolved, missing)):
            self.schemas[n] = s
        return {n: self.schemas[n] for n in numbers}

    def text(self, number: int) -> str:
        """A writer schema's text, fetched now if it must be; for codecs' ``writer``."""
        return self.fetch([number])[number].text

    def writer_schema(self, number: int) -> Schema:
        """The schema if it is here; else one fetch begins in the background and :class:`SchemaPending` is raised."""
        with self._lock:
            if number in self.schemas:
                return self.schemas[number]
            future = self._pending.get(number)
            if future is None or future.done() and future.exception() is not None:
                future = self._pending[number] = self._pool.submit(self.client.resolved, number)
                future.add_done_callback(lambda f: self._publish(number, f))
        raise SchemaPending(number)

    def _publish(self, number: int, future: Future) -> None:
        if future.exception() is None:
            with self._lock:
                self.schemas[number] = future.result()
                self._pending.pop(number, None)

    def close(self) -> None:
        self._pool.shutdown(wait=False, cancel_futures=True)


@dataclass
class JsonSerde:
    """Registry-framed JSON text columns, validated on both sides unless told not to. For one role of a topic."""

    cache: SchemaCache
    schema: dict
    role: Role = Role.VALUE
    subject: SubjectName = topic_name
    validate: bool = True

    def register(self, topic: str) -> None:
        self.cache.intern(self.subject(topic, self.role), Schema(json.dumps(self.schema), "JSON"))

    def _need(self, role: Role) -> None:
        if role is not self.role:
            raise LakeError(f"this serde is for a {self.role.value}")

    def encode(self, topic: str, text: Column, role: Role = Role.VALUE) -> Column:
        self._need(role)
        checked = valid_json(text, self.schema) if self.validate else text
        return framing.frame(checked.cast("binary"), self.cache.id_for(self.subject(topic, self.role)))

    def decode(self, framed: Column, role: Role = Role.VALUE) -> Column:
        self._need(role)
        text = framing.body(framed).cast("string")
        return valid_json(text, self.schema) if self.validate else text


def avro_codec(cache: SchemaCache, topic: str, schema: str, subject: SubjectName = topic_name):
    """An Avro codec of a topic's values, its schema registered in canonical form."""
    from .avro import AvroCodec, canonical

    name = subject(topic, Role.VALUE)
    cache.intern(name, Schema(canonical(schema), "AVRO"))
    return AvroCodec(schema, cache.text, lambda: cache.id_for(name))


def protobuf_codec(cache: SchemaCache, topic: str, descriptor, subject: SubjectName = topic_name):
    """A Protobuf codec of a topic's values, its file registered as .proto text."""
    from .protobuf import ProtobufCodec, print_schema

    name = subject(topic, Role.VALUE)
    cache.intern(name, Schema(print_schema(descriptor.file), "PROTOBUF"))
    return ProtobufCodec(descriptor, lambda: cache.id_for(name))


@dataclass
class TopicCodec(Codec):
    """A registry codec whose subject follows the topic that a topology reads or writes.

    ``make`` is :func:`avro_codec` or :func:`protobuf_codec`; the ids of the topics named must be known before they
    are written (``intern`` them by name and prewarm the cache).
    """

    cache: SchemaCache
    make: Callable[..., Codec]
    schema: Any
    subject: SubjectName = topic_name

    def intern(self, *topics: str) -> None:
        for t in topics:
            self.for_topic(t)

    def for_topic(self, topic: str) -> Codec:
        return self.make(self.cache, topic, self.schema, self.subject)


class RegistryStub:
    """A registry in memory behind HTTP, for tests: register, look up, latest version, schema by id. Counts its requests."""

    def __init__(self) -> None:
        self.by_id: dict[int, dict] = {}
        self.subjects: dict[str, list[int]] = {}
        self.requests: list[str] = []
        self.fail: list[int] = []  # statuses that the next requests get
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self) -> None:
                path = [urllib.parse.unquote(p) for p in self.path.split("?")[0].strip("/").split("/")]
                n = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(n)) if n else None
                stub.requests.append(f"{self.command} {self.path}")
                status, answer = (stub.fail.pop(0), {"message": "asked to fail"}) if stub.fail else stub.answer(self.command, path, body)
                data = json.dumps(answer).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = _do  # noqa: N815

            def log_message(self, *args: Any) -> None:
                return None

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        self.config: dict[str, str] = {"": "BACKWARD"}
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, method: str, path: list[str], body: dict | None) -> tuple[int, Any]:
        missing = (404, {"error_code": 40401, "message": "not found"})
        if path[0] == "schemas":
            s = self.by_id.get(int(path[2]))
            return (200, s) if s else missing
        if path[0] == "config":
            name = path[1] if len(path) > 1 else ""
            if method == "PUT":
                self.config[name] = body["compatibility"]
                return 200, body
            return (200, {"compatibilityLevel": self.config[name]}) if name in self.config else missing
        if path == ["subjects"]:
            return 200, sorted(self.subjects)
        ids = self.subjects.get(path[1], [])
        if method == "DELETE":
            if len(path) == 2:
                return (200, list(range(1, 1 + len(self.subjects.pop(path[1]))))) if ids else missing
            return 200, int(path[3])
        if method == "POST":
            known = next((i for i, s in self.by_id.items() if s == body), None)
            if len(path) == 2:
                return (200, {"id": known, "subject": path[1], "version": ids.index(known) + 1, **body}) if known in ids else missing
            if known is None:
                known = len(self.by_id) + 1
                self.by_id[known] = body
            if known not in ids:
                self.subjects.setdefault(path[1], []).append(known)
            return 200, {"id": known}
        if not ids:
            return missing
        if len(path) == 3:
            return 200, list(range(1, 1 + len(ids)))
        v = len(ids) if path[3] == "latest" else int(path[3])
        return (200, {"subject": path[1], "version": v, "id": ids[v - 1], **self.by_id[ids[v - 1]]}) if 0 < v <= len(ids) else missing

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


