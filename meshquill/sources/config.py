"""Configuration files."""

import json

VERSION, COMMIT = "0.1.0", "unreleased"


def parse(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def version() -> str:
    return VERSION


def git_commit_hash() -> str:
    return COMMIT
