"""What a source raises for bytes that it does not read."""


class Unsupported(ValueError):
    """The bytes are not a waveform that this package decodes."""
