"""Weights of the field in pii.py, as pii.train(**pii.TRAINED) gives them: WEIGHTS by feature and kind, STEPS by label and label before it."""

# fmt: off
STEPS = [
    [-0.659, -2.841, -2.358, -1.791, -1.946, -2.997, -2.060],
    [-2.767, -2.812, -2.553, -2.410, -2.970, -3.343, -2.638],
    [-1.987, -2.511, -2.425, -2.311, -2.834, -2.725, -2.501],
    [-1.368, -2.363, -2.309, -2.244, -2.642, -2.639, -2.365],
    [-1.581, -3.155, -3.024, -2.869, -4.693, -3.059, -3.527],
    [-2.347, -2.652, -2.486, -2.401, -2.733, -4.848, -2.526],
    [-1.660, -2.622, -2.496, -2.363, -3.243, -2.757, -2.664],
]
WEIGHTS = [
    [-2.867, -2.421, -1.863, -2.131, -3.139, -2.162],
    [-1.248, -0.250, -0.835, -1.460, 0.104, -1.456],
    [-3.151, -2.677, -1.347, -1.693, -2.531, -1.604],
    [1.589, -2.978, -2.956, -2.939, 0.840, -2.609],
    [-3.867, -1.657, -1.358, -2.082, 8.337, -1.613],
    [4.443, -2.344, -1.862, -2.302, -2.658, -2.008],
    [3.728, -1.944, -1.785, -2.026, -2.045, -1.876],
    [-5.491, -5.447, -1.498, -4.504, -4.551, -4.940],
    [-4.061, -2.899, -1.966, -2.497, -2.778, -2.095],
    [-4.055, -2.890, -1.962, -2.490, -2.771, -2.090],
    [-0.351, 6.320, -3.571, -4.246, -1.629, -3.911],
    [-0.350, -6.880, -0.644, -6.289, -3.915, -5.780],
    [-4.757, 4.580, -2.694, -4.473, -3.996, -4.406],
    [-2.349, -1.339, 6.357, 0.074, -2.623, -2.816],
    [-2.773, -1.162, -4.526, 0.607, -3.322, -3.640],
    [-2.141, -2.439, 5.422, -2.505, -2.341, -2.358],
    [-2.638, -3.880, 1.437, 4.231, -2.346, -1.612],
    [-3.166, 3.284, -0.207, 3.959, 0.921, 3.716],
    [-2.927, -3.894, -3.396, 5.928, -2.664, -4.234],
    [0.019, 0.330, -1.916, 3.590, -0.122, -0.455],
    [-1.344, -2.467, -1.556, -2.593, -1.359, 3.995],
    [-2.324, -3.563, -3.300, -3.541, -2.485, 5.811],
    [-1.057, -1.565, -0.904, -2.200, -0.914, 3.542],
    [-2.517, -2.150, -2.081, -2.118, 3.932, -2.106],
    [-3.236, -2.429, -2.336, -2.357, 4.801, -2.367],
    [-2.194, -2.031, -2.001, -2.010, 3.321, -2.014],
    [-1.870, -1.804, -1.791, -1.792, 3.020, -1.793],
    [-2.030, -1.925, -1.828, -1.864, 4.023, -1.839],
    [-2.040, -1.812, -1.784, -1.833, 3.223, -1.803],
    [-2.121, -1.969, -1.821, -1.871, 4.765, -1.840],
    [-2.214, -1.976, -1.898, -1.907, 4.651, -1.911],
    [0.000, 0.000, 0.000, 0.000, 0.000, 0.000],
    [-2.028, -1.829, -1.810, -1.813, 5.845, -1.815],
    [-2.954, -2.280, -2.237, -2.248, -6.472, -2.259],
    [-1.833, -2.192, -2.129, -2.174, 6.176, -2.189],
    [-3.356, -2.496, -2.433, -2.445, -4.960, -2.464],
    [-1.941, -1.882, -1.831, -1.831, 3.731, -1.833],
    [-1.769, -1.769, -1.741, -1.740, 3.275, -1.740],
    [-1.756, -1.756, -1.726, -1.724, 3.421, -1.724],
    [-2.024, -1.951, -1.976, -1.889, 2.605, -1.891],
    [-1.938, -1.893, -1.841, -1.839, 2.614, -1.840],
    [-1.755, -1.684, -1.651, -1.653, 3.604, -1.654],
    [-0.668, 3.201, -3.064, -1.950, 1.346, -3.781],
    [-1.930, -3.212, 0.060, -2.628, 2.674, -1.896],
    [-4.424, -3.209, -3.310, -2.525, -2.122, -2.533],
    [-4.621, -6.149, -5.582, -6.269, -4.040, -0.076],
    [-2.662, -2.052, -2.652, -2.410, -2.671, -2.758],
    [3.390, -4.010, 3.281, 0.672, 4.123, 1.406],
    [2.196, -0.058, -2.017, -1.451, -0.640, -2.608],
    [-3.235, -3.166, -2.744, -2.909, -3.417, -3.071],
    [-2.878, -1.364, -2.629, -2.848, -3.086, -2.684],
    [-2.040, -1.812, -1.784, -1.833, 3.223, -1.803],
]
