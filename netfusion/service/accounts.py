"""Accounts with roles and states, salted password hashes and signed tokens; no Spark."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

ROLES = ("investigator", "supervisor", "analyst")
STATES = ("pending", "active", "disabled", "rejected")
CAN_VIEW_GRAPH = frozenset({"investigator", "supervisor"})
CAN_UPLOAD = frozenset(ROLES)
CAN_ADMIN = frozenset({"supervisor"})
TTL = 8 * 3600


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


class Accounts:
    def __init__(self, secret: bytes):
        self.secret, self.users = secret, {}

    @staticmethod
    def _hash(password: str, salt: bytes) -> str:
        return hashlib.scrypt(password.encode(), salt=salt, n=2**12, r=8, p=1).hex()

    def register(self, name: str, password: str, role: str = "investigator", state: str = "pending") -> dict:
        if name in self.users or role not in ROLES or state not in STATES or len(password) < 8:
            raise ValueError("can't register")
        salt = os.urandom(16)
        self.users[name] = {"name": name, "role": role, "state": state, "salt": salt, "hash": self._hash(password, salt)}
        return self.public(name)

    def public(self, name: str) -> dict:
        return {k: self.users[name][k] for k in ("name", "role", "state")}

    def set_state(self, name: str, state: str) -> dict:
        if state not in STATES:
            raise ValueError("unknown state")
        self.users[name]["state"] = state
        return self.public(name)

    def list(self, state: str | None = None) -> list[dict]:
        order = {s: i for i, s in enumerate(STATES)}
        every = [self.public(n) for n in self.users if state in (None, self.users[n]["state"])]
        return sorted(every, key=lambda u: (order[u["state"]], u["name"]))

    def login(self, name: str, password: str, now: float | None = None) -> str:
        user = self.users.get(name)
        if user is None or user["state"] != "active" or not hmac.compare_digest(user["hash"], self._hash(password, user["salt"])):
            raise PermissionError("wrong name or password")
        body = _b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()) + "." + _b64(json.dumps({"sub": name, "role": user["role"], "exp": (now or time.time()) + TTL}).encode())
        return f"{body}.{_b64(hmac.new(self.secret, body.encode(), hashlib.sha256).digest())}"

    def check(self, token: str, allowed: frozenset[str] = frozenset(ROLES), now: float | None = None) -> dict:
        """The token's user; raises if it is forged, expired, of a user who isn't active, or of a role that isn't allowed."""
        body, _, signature = token.rpartition(".")
        if not hmac.compare_digest(_b64(hmac.new(self.secret, body.encode(), hashlib.sha256).digest()), signature):
            raise PermissionError("bad token")
        claims = json.loads(_unb64(body.split(".")[1]))
        user = self.users.get(claims["sub"])
        if claims["exp"] < (now or time.time()) or user is None or user["state"] != "active":
            raise PermissionError("token no longer valid")
        if user["role"] not in allowed:
            raise PermissionError("not allowed")
        return self.public(claims["sub"])
