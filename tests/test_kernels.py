"""NumPy kernels: identities, lengths and the loudness standard."""

import numpy as np
import pytest

from cliploom.functions import kernels as k


def tone(frequency, rate=48000, seconds=1.0, amplitude=0.1):
    return amplitude * np.sin(2 * np.pi * frequency * np.arange(int(rate * seconds)) / rate)[None, :]


@pytest.mark.parametrize("length", [44100, 44101])
@pytest.mark.parametrize("hop", [0.25, 0.5])
def test_inverse_of_spectrum(length, hop):
    x = np.random.default_rng(0).uniform(-1, 1, (1, length))
    z = k.stft(x, 2048, hop)
    assert np.allclose(k.istft(z, 2048, int(2048 * hop), length=length), x, atol=1e-9)


def test_short_signal_and_even_frames():
    x = np.random.default_rng(0).uniform(-1, 1, (2, 50))
    assert np.allclose(k.istft(k.stft(x, 64, 0.5), 64, 32, length=50), x)
    with pytest.raises(ValueError):
        k.stft(x, 63)
    with pytest.raises(ValueError):
        k.window_of("unknown", 8)


@pytest.mark.parametrize(("old", "new"), [(44100, 96000), (48000, 44100), (2, 3), (3, 2), (8000, 8000)])
def test_resampled_lengths_and_gain(old, new):
    x = np.ones((2, 900))
    y = k.resample(x, old, new)
    assert y.shape == (2, 900 * new // old)
    edge = 100 * new // old
    assert np.allclose(y[:, edge:-edge], 1, atol=1e-6)
    assert k.resample(x, old, new, full=True).shape[1] == -(-900 * new // old)
    assert k.resample(np.zeros((1, 441)), old, new).any() == False  # noqa: E712
    if old != new:
        import math

        d = math.gcd(old, new)
        rows, _ = k.resample_kernel(old // d, new // d, 24, 0.945)
        assert np.allclose(rows.sum(axis=1), 1)


def test_resample_keeps_a_tone():
    y = k.resample(tone(1000, 48000), 48000, 32000)
    assert np.allclose(y[0, 500:-500], tone(1000, 32000)[0, 500:-500], atol=1e-4)


def test_resample_arguments():
    x = np.zeros((1, 100))
    for bad in ({"output_length": 201}, {"output_length": -1}, {"output_length": 5, "full": True}):
        with pytest.raises(ValueError):
            k.resample(x, 1, 2, **bad)
    with pytest.raises(ValueError):
        k.resample(x, 44100.5, 48000)
    assert k.resample(x, 1, 2, output_length=150).shape == (1, 150)


def test_k_weighting_reproduces_the_standard_at_48_khz():
    (b, a), (_, high) = k.k_weighting(48000)
    assert np.allclose(b, [1.53512485958697, -2.69169619391839, 1.19839281085285], atol=1e-7)
    assert np.allclose(a[1:], [-1.69065929318241, 0.73248077421585], atol=1e-9)
    assert np.allclose(high[1:], [-1.99004745483398, 0.99007225036621], atol=1e-9)


def test_loudness_of_tones():
    assert abs(k.integrated_loudness(tone(1000), 48000) + 23.0) < 0.1
    assert abs(k.integrated_loudness(tone(1000), 48000, kind="iir") + 23.0) < 0.1
    assert abs(k.integrated_loudness(tone(60), 48000, kind="iir") + 26.6) < 0.15
    assert k.integrated_loudness(tone(60), 48000) < k.integrated_loudness(tone(60), 48000, kind="iir") - 0.3
    assert abs(k.integrated_loudness(np.repeat(tone(1000), 2, axis=0), 48000) - k.integrated_loudness(tone(1000), 48000) - 3.01) < 0.01


def test_loudness_of_silence_and_short_clips():
    assert k.integrated_loudness(np.zeros((1, 48000)), 48000) == k.SILENCE
    assert k.integrated_loudness(np.zeros((1, 10)), 48000) == k.SILENCE
    assert -40 < k.integrated_loudness(tone(1000, seconds=0.1), 48000) < -23


def test_gate_drops_quiet_parts():
    loud, quiet = tone(1000, seconds=2), tone(1000, seconds=20, amplitude=0.001)
    whole = k.integrated_loudness(np.concatenate([loud, quiet], axis=1), 48000)
    assert abs(whole - k.integrated_loudness(loud, 48000)) < 0.5


def test_no_phase_change_is_identity_and_magnitudes_stay():
    x = np.random.default_rng(1).uniform(-1, 1, (2, 5000))
    assert np.allclose(k.rotate(x, np.zeros((2, 1)), 512, 0.5, "hann"), x)
    assert np.allclose(k.rotate(x, np.full((2, 1), np.pi), 512, 0.5, "hann"), -x)
