"""Wording of public licences, clause by clause: (label, words in lower case). Clauses that several licences share are left out."""

# Licence texts as their stewards publish them.
CLAUSES = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
     software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
     persons to whom the software is furnished to do so subject to the following conditions"""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
     permission notice appear in all copies"""),
    ("isc", """the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
     in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"""),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce
     the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("bsd-3", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
     written permission"""),
    ("bsd", """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
     merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
     exemplary or consequential damages"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
     permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"""),
    ("zlib", """the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
     product documentation would be appreciated but is not required"""),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
     to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"""),
    ("bsl", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
     http www apache org licenses license 2 0"""),
    ("apache", """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
     either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("apache", """subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright
     license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"""),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
     see the gnu general public license for more details"""),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
     http mozilla org mpl 2 0"""),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("postgresql", """permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided
     that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"""),
    ("artistic", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("zlib", "licensed under the zlib license"),
    ("apache", "spdx license identifier apache 2 0"),
    ("mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("gpl", "spdx license identifier gpl 2 0"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl 2 1"),
    ("agpl", "spdx license identifier agpl 3 0"),
    ("mpl", "spdx license identifier mpl 2 0"),
)
