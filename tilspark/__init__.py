"""Speech-text analytics as DataFrame programs: normalisation, morphology, error rates, language models, CTC decoding."""

__version__ = "0.1.0"
