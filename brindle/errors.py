"""What a request can be refused for."""


class Refused(ValueError):
    """The request asks for something that this engine deliberately does not serve, or that makes no sense."""
