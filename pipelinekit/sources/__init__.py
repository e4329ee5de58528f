from pipelinekit.sources.datasets import DatasetSpec, read, write
from pipelinekit.sources.fixtures import fixture_frame

__all__ = ["DatasetSpec", "fixture_frame", "read", "write"]
