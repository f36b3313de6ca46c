"""Errors of statements: a code and a message.  A failed statement leaves its session usable."""


class EngineError(Exception):
    """Base of all statement errors; ``code`` names the kind."""

    code = "Error"

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


def _kind(name: str, about: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": name, "__doc__": about, "__module__": __name__})


CreateError = _kind("CreateError", "A database or table can't be created.")
DatabaseNotExists = _kind("DatabaseNotExists", "The named database doesn't exist.")
DropError = _kind("DropError", "A database or table can't be dropped.")
SyntaxError_ = _kind("SyntaxError", "The text is no statement of the dialect.")
BindError = _kind("BindError", "A name, type or argument doesn't fit.")
NotChoiceDatabase = _kind("NotChoiceDatabase", "The statement needs a current database.")
IOError_ = _kind("IOError", "Storage failed.")
BufferPoolError = _kind("BufferPoolError", "Kept for its code; Spark manages memory.")
NotFound = _kind("NotFound", "The named table doesn't exist.")
DataTooLarge = _kind("DataTooLarge", "A statement is larger than the limit.")
InsertError = _kind("InsertError", "Rows can't be inserted.")
FileNotOpen = _kind("FileNotOpen", "A file can't be opened.")
ExecutionError = _kind("ExecutionError", "Spark failed while it ran the statement, as on division by zero.")
