"""What a caller can have asked wrongly, each with the status that a service would answer."""


class RequestError(ValueError):
    """A parameter out of its bounds."""

    status = 400


class NotFound(RequestError):
    """Nothing was shipped under the key asked for."""

    status = 404


class NotReady(RequestError):
    """A result that hasn't been made yet: rows not cleaned, an export still running."""

    status = 409


class TooFewPeriods(RequestError):
    """Not enough periods to train on and to test."""

    status = 422


def within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise RequestError(f"{name} is {low} to {high}, not {value}")


def one_of(name: str, value, known) -> None:
    if value not in known:
        raise RequestError(f"{name} is one of {', '.join(map(str, known))}, not {value}")
