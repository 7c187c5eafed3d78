"""Errors, raised on the driver when a query is put together wherever that is possible."""


class NoteError(Exception):
    """Any error of this package."""


class VaultNotFound(NoteError):
    pass


class FolderNotFound(NoteError):
    pass


class NoFrontmatter(NoteError):
    pass


class InvalidFrontmatter(NoteError):
    pass


class InvalidPredicate(NoteError):
    pass


class RegexError(NoteError):
    pass


class SchemaError(NoteError):
    pass


class SafetyRefused(NoteError):
    pass


class EditError(NoteError):
    pass
