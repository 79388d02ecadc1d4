"""What can go wrong, as exceptions for drivers and as names in `error` columns."""


class PdfFault(ValueError):
    """A file that can't be read or an argument that makes no sense."""


class PasswordRefused(PdfFault):
    """A password is needed or wrong."""


class HandleClosed(PdfFault):
    """The document was closed."""


class StillEncrypted(PdfFault):
    """The document's content needs a password first."""


class StaleView(PdfFault):
    """A page view outlived a change of the page set."""


class FaultWarning(UserWarning):
    """Something was left out."""
