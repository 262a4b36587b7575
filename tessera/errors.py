"""The two kinds of failure: SQL that is wrong, and SQL that the dialect leaves out."""


class SQLError(Exception):
    """Invalid SQL, or a statement that cannot be carried out."""


class UnsupportedError(Exception):
    """Valid SQL outside the dialect."""

    def __init__(self, feature: str):
        super().__init__(f"unsupported SQL construct: {feature}")
        self.feature = feature
