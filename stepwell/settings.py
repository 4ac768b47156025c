"""Settings of the engine, one object for the process."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Settings:
    cached: bool = True  # reuse what a process has loaded
    save_with_param: bool = True  # put the id of a task into its paths
    dirpath: str = "data"
    code_version_auto: bool = True  # hash a task's code where it has no pinned version
    expensive_seconds: float = 600.0  # an unpinned step that took longer is not rerun for a code change alone
    events: bool = True
    events_dir: str = ".stepwell"
    check_dependencies: bool = True
    log_level: str = "WARNING"
    execution_summary: bool = True
    storage: str | None = None  # prefix of all relative paths, e.g. s3a://bucket/prefix
    workers: int = 8  # independent steps made at a time
    summary_params: int = 20
    summary_chars: int = 64
    extra: dict = field(default_factory=dict)


settings = Settings()


def set_dir(dir: str | None = None) -> str:
    """Set (or read) the data root."""
    if dir is not None:
        settings.dirpath = str(dir)
    return settings.dirpath


def enable_cloud_storage(protocol: str, bucket: str, prefix: str = "") -> str:
    """Put all relative paths under a store that Spark's Hadoop connectors read, e.g. ('s3a', 'bucket', 'folder')."""
    settings.storage = f"{protocol}://{bucket}" + (f"/{prefix.strip('/')}" if prefix.strip("/") else "")
    return settings.storage


def enable_gcs(bucket: str, prefix: str = "") -> str:
    return enable_cloud_storage("gs", bucket, prefix)


def located(path: str) -> str:
    """A path under the store where one is set; absolute paths and URIs stay."""
    if settings.storage and "://" not in path and not path.startswith("/"):
        return f"{settings.storage}/{path}"
    return path
