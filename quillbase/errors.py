"""Errors that operators and commands raise, with a stable name and whether a retry can help."""

from __future__ import annotations


class KnowledgeError(Exception):
    """name is stable across releases; retryable says that the same request may succeed later."""

    name = "internal"
    retryable = False


def _kind(class_name: str, name: str, retryable: bool = False) -> type[KnowledgeError]:
    return type(class_name, (KnowledgeError,), {"name": name, "retryable": retryable, "__module__": __name__})


InvalidArgument = _kind("InvalidArgument", "invalid_argument")
KnowledgeBaseNotFound = _kind("KnowledgeBaseNotFound", "knowledge_base_not_found")
KnowledgeBaseDeleting = _kind("KnowledgeBaseDeleting", "knowledge_base_deleting")
VersionNotFound = _kind("VersionNotFound", "version_not_found")
ParentNotFound = _kind("ParentNotFound", "parent_version_not_found")
ParentHasChild = _kind("ParentHasChild", "parent_version_has_child")
ParentNotDurable = _kind("ParentNotDurable", "parent_version_not_durable", True)
VersionActive = _kind("VersionActive", "version_active")
VersionPending = _kind("VersionPending", "version_pending", True)
VersionNotDurable = _kind("VersionNotDurable", "version_not_durable", True)
VersionDeleting = _kind("VersionDeleting", "version_deleting")
VersionFailed = _kind("VersionFailed", "version_failed_permanent")
IndexNotReady = _kind("IndexNotReady", "index_not_ready", True)
DataIncomplete = _kind("DataIncomplete", "data_incomplete", True)
StaleRead = _kind("StaleRead", "stale_read", True)
UnsupportedFile = _kind("UnsupportedFile", "unsupported_file")

BY_NAME = {c.name: c for c in list(vars().values()) if isinstance(c, type) and issubclass(c, KnowledgeError)}


def failure_class(error: Exception) -> str:
    """TRANSIENT where a retry may help or the cause is unknown, FATAL_GLOBAL where every replica would fail alike."""
    return "FATAL_GLOBAL" if isinstance(error, KnowledgeError) and not error.retryable else "TRANSIENT"
