"""Digests of the canonical forms of whole licence texts (licenses.digest): id, what of the text, digest (fixed values)."""

DIGESTS = (
    ("Apache-2.0", "whole", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Apache-2.0", "without appendix", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("Apache-2.0", "up to the end of terms", "0c625737207ff21211498d94941901de5bca68c965547007c169a1e718b97f16"),
    ("Apache-2.0", "appendix filled in", "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c"),
    ("Artistic-1.0-Perl", "whole", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "whole", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "whole", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "whole", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "whole", "13d0d869218dcb4c3081de58a2e7495b3e179cbde17dc467abef259cc651e060"),
    ("GPL-1.0", "without appendix", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "up to the end of terms", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "whole", "05c91fafdc9e3a67a0a0778f3285c8c6401db1af7a594a7f138bef01accb905b"),
    ("GPL-2.0", "without appendix", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "up to the end of terms", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "whole", "0b8cb739fb6b676bfa54a8b5f69a6f215926db7e82c99d5adda457169e3a2a76"),
    ("GPL-3.0", "without appendix", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "up to the end of terms", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "whole", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "without appendix", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "up to the end of terms", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "whole", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "without appendix", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "up to the end of terms", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "whole", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "whole", "8fbb2fea34a4718639184be831ff1e62262e3fc5f93773974477cf9358140bf1"),
    ("MPL-2.0", "whole", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("Unlicense", "whole", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("BSL-1.0", "whole", "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6"),
    ("BSL-1.0", "without title", "d74569b0dbb4e34ddb322196b65108cbcbb6a611548512c4ce4ab27c2670349a"),
)
