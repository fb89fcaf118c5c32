"""One exception class for each part that can refuse its input."""


class PeerloomError(Exception):
    pass


class NpyError(PeerloomError):
    pass


class TopologyError(PeerloomError):
    pass


class CodecError(PeerloomError):
    pass


class TrainerError(PeerloomError):
    pass


class RoundError(PeerloomError):
    pass


class ShardError(PeerloomError):
    pass
